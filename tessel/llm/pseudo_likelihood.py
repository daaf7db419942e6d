"""Masked pseudo-likelihood: a small network predicts every word from the two words on either side.

1. All words of all documents are counted: a table that grows with the corpus. Words that make up
   `least_share` of the corpus or more are the vocabulary, so it has at most 1 / `least_share` words
   whatever the input; that bounds what is sent to the executors. Other words are rare: they are one
   entry for each of four lengths, and are told apart by their spelling.
2. Entries are put into classes of about equal mass, most frequent first. A network over the window
   (the classes of both neighbours, and a coarser grouping of the words beyond) predicts the class
   of the word in the middle; it is trained in numpy on the exact counts of all windows of the corpus.
3. The network's hidden layer parts the windows into contexts (k-means). How often each entry stands
   in each context is counted over all documents, so an entry's share of its class depends on the
   window as well.
4. log p(word | window) = log p(class | window) + log p(entry | class, context), and for a rare word
   its spelling's log-probability: bytes, each after the classes of two bytes before, up to the end
   of the word, counted over all texts.

Texts are read twice: to count words, and to write each document's entries, from which all else is
counted. Each task counts its own documents and sends what it found, tasks are added up by a shuffle. As
windows are finite, the network's log-probabilities are tabulated once, and scoring looks them up. Places
outside a text are a class of their own.

Defined results: null and empty texts have no words, log_prob 0 and a null score; repeated rows and
null doc_ids are scored as they are; words are compared without ASCII letter case; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, flat_binary, raw_texts, release_memory
from tessel.llm.superminhash import FOLD, WordHashes

#: Rare words are parted by their number of bytes, at these borders.
LENGTHS = (5, 9, 15)
RARE = len(LENGTHS) + 1
#: Classes of bytes that spelling looks back on: a space, each letter a-z, digits, other ASCII, and other bytes by their upper bits.
BEHIND = 37
CLASS_OF = np.array([0 if b == 32 else 1 + b - 97 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 if b < 128 else 29 + (b - 128) // 16 for b in range(256)])
SPELLING = 9  # kind of the counts of spelling; those of words are of kinds 0 to 3, by length


@dataclass(frozen=True)
class Shape:
    """Classes of entries (class 0 is outside the text), groups of classes for the outer places, contexts of windows."""

    classes: int = 48
    groups: int = 6
    contexts: int = 12

    def group(self, c: np.ndarray) -> np.ndarray:
        return np.where(c == 0, 0, 1 + (c - 1) * (self.groups - 1) // (self.classes - 1))

    @property
    def windows(self) -> int:
        return self.groups * self.classes * self.classes * self.groups


def words_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words, and the number of words of each text."""
    found = [x.translate(FOLD).split() for x in texts]
    return list(chain.from_iterable(found)), np.array([len(x) for x in found], dtype=np.int64)


def spelling_codes(words: list[bytes]) -> np.ndarray:
    """For each byte of the words and the space behind each: the classes of two bytes before (spaces at the start), and the byte."""
    b = np.frombuffer(b"  " + b"  ".join(words) + b" ", dtype=np.uint8)
    c = CLASS_OF[b]
    codes = (c[:-2] * BEHIND + c[1:-1]) * 256 + b[2:]
    return codes[~((b[2:] == 32) & (b[1:-1] == 32))]  # the second space between words is no part of either


class Entries(dict):
    """The entry of each word: its place in the vocabulary, or behind that the rare words of its length."""

    def __init__(self, vocabulary: np.ndarray):
        self.place, self.size = {h: k for k, h in enumerate(vocabulary.tolist())}, len(vocabulary)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        found = self.place.get(xxhash.xxh64_intdigest(word))
        self[word] = found = self.size + int(np.searchsorted(LENGTHS, len(word), side="right")) if found is None else found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def word_counts(docs: DataFrame, scratch: Scratch, most_held: int = 1_000_000) -> DataFrame:
    """kind, key and n over all documents: words by length (key: hash), and spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = np.zeros(BEHIND * BEHIND * 256, dtype=np.int64)
        hashes, held, size = WordHashes(), [], 0

        def rows(kind: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(kind.astype(np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        def merged() -> list[np.ndarray]:
            key, kind, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key, kind="stable")
            new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
            return [key[order][new], kind[order][new], np.add.reduceat(n[order], new)]

        for batch in batches:
            words, _ = words_of(list(raw_texts(batch)))
            if not words:
                continue
            key, first, n = np.unique(np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)), return_index=True, return_counts=True)
            own = [words[k] for k in first.tolist()]
            sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            held.append([key, np.searchsorted(LENGTHS, sizes, side="right"), n])
            size += len(key)
            spelling += np.bincount(spelling_codes(own), weights=np.repeat(n, sizes + 1), minlength=len(spelling)).astype(np.int64)
            if size > most_held:
                held = [merged()]
                size = len(held[0][0])
                if size > most_held // 2:
                    key, kind, n = held[0]
                    yield rows(kind, key.view(np.int64), n)
                    held, size = [], 0
        if held:
            key, kind, n = merged()
            yield rows(kind, key.view(np.int64), n)
        code = np.flatnonzero(spelling)
        yield rows(np.full(len(code), SPELLING), code, spelling[code])
        hashes.clear()
        release_memory()

    rows = docs.select("text").mapInArrow(run, "kind int, key long, n long")
    return scratch.save(rows.groupBy("kind", "key").agg(F.sum("n").alias("n")), "words")


def assign_classes(counts: np.ndarray, shape: Shape) -> np.ndarray:
    """A class from 1 on for each entry: entries in order of count, cut where the mass passes equal shares; frequent ones stay alone."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out, left, share = np.full(len(counts), shape.classes - 1, dtype=np.int64), float(counts.sum()), 0.0
    now, room = 1, left / (shape.classes - 1)
    for entry in order[: int((counts > 0).sum())].tolist():
        if share and share + counts[entry] > room and now < shape.classes - 1:
            left -= share
            now, share = now + 1, 0.0
            room = left / (shape.classes - now)
        out[entry] = now
        share += counts[entry]
    return out


def windows_of(c: np.ndarray, counts: np.ndarray, shape: Shape) -> np.ndarray:
    """The number of the window around each word; c: classes of all words of the texts."""
    if not len(c):
        return c
    at = np.arange(len(c)) + 2 + 2 * np.repeat(np.arange(len(counts)), counts)  # two places outside between texts
    padded = np.zeros(len(c) + 2 * len(counts) + 4, dtype=np.int64)
    padded[at] = c
    outer = shape.group(padded)
    return ((outer[at - 2] * shape.classes + padded[at - 1]) * shape.classes + padded[at + 1]) * shape.groups + outer[at + 2]


def spelt(words: list[bytes], spelling: np.ndarray) -> np.ndarray:
    """The log-probability of each word's spelling, its end included."""
    own = list(dict.fromkeys(words))
    if not own:
        return np.zeros(0)
    begin = np.cumsum([0, *(len(x) + 1 for x in own[:-1])])
    known = dict(zip(own, np.add.reduceat(spelling[spelling_codes(own)].astype(np.float64), begin).tolist(), strict=True))
    return np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))


def entered(docs: DataFrame, vocabulary, spelling, scratch: Scratch) -> DataFrame:
    """doc_id, entries (little-endian unsigned 32-bit) and spelt (the sum over rare words) of each row. vocabulary and spelling are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = Entries(vocabulary.value)
        for batch in batches:
            words, counts = words_of(list(raw_texts(batch)))
            entry = entries.of(words)
            rare = np.flatnonzero(entry >= entries.size)
            sums = np.bincount(np.repeat(np.arange(len(counts)), counts)[rare], weights=spelt([words[k] for k in rare.tolist()], spelling.value), minlength=len(counts))
            yield pa.record_batch([batch.column("doc_id"), flat_binary(entry.astype("<u4").tobytes(), 4 * counts), pa.array(sums.astype(np.float64))], names=["doc_id", "entries", "spelt"])
        entries.clear()
        release_memory()

    return scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, entries binary, spelt double"), "entries")


def entries_in(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all rows one after the other, and the number of each row."""
    own = list(raw_texts(batch, "entries"))
    return np.frombuffer(b"".join(own), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in own], dtype=np.int64)


def summed(rows: DataFrame, code_of, size: int) -> np.ndarray:
    """Counts of codes below `size` over all rows of entries; `code_of` gives the codes of a batch's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(code_of(*entries_in(batch)), minlength=size)
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])
        del total, code
        release_memory()

    found = rows.select("entries").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, dtype=np.int64)
    total[found["code"].to_numpy()] = found["n"].to_numpy()
    return total


class Network:
    """Embeddings of four window places, one hidden layer, a softmax over classes."""

    def __init__(self, shape: Shape, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.shape = shape
        sizes = [(shape.groups, hidden), (shape.classes, hidden), (shape.classes, hidden), (shape.groups, hidden), (hidden,), (hidden, shape.classes), (shape.classes,)]
        self.weights = [(rng.normal(0, 0.3, x) if len(x) == 2 else np.zeros(x)).astype(np.float32) for x in sizes]

    def places(self, window: np.ndarray) -> list[np.ndarray]:
        s = self.shape
        return [window // (s.groups * s.classes * s.classes), window // (s.groups * s.classes) % s.classes, window // s.groups % s.classes, window % s.groups]

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer, and log-probabilities of the classes."""
        hidden = np.tanh(sum(self.weights[k][p] for k, p in enumerate(self.places(window))) + self.weights[4])
        logit = hidden @ self.weights[5] + self.weights[6]
        logit[:, 0] = -np.inf  # no word is outside
        logit -= logit.max(axis=1, keepdims=True)
        return hidden, logit - np.log(np.exp(logit).sum(axis=1, keepdims=True))

    def train(self, counts: np.ndarray, rounds: int = 120, rate: float = 0.05) -> list[float]:
        """Adam on the log-likelihood of all counted windows; counts: windows by classes. Gives the loss of each round."""
        window = np.flatnonzero(counts.sum(axis=1))
        if not len(window):
            return []
        counts = counts[window].astype(np.float32)
        total, mass = counts.sum(), counts.sum(axis=1, keepdims=True)
        places, losses = self.places(window), []
        hot = [np.eye(len(self.weights[k]), dtype=np.float32) for k in range(4)]
        m, v = [np.zeros_like(x) for x in self.weights], [np.zeros_like(x) for x in self.weights]
        for step in range(1, rounds + 1):
            grads = [np.zeros_like(x) for x in self.weights]
            loss = 0.0
            for a in range(0, len(window), 8192):
                part = slice(a, a + 8192)
                hidden, logp = self.forward(window[part])
                loss -= float((counts[part][:, 1:] * logp[:, 1:]).sum())
                error = (np.exp(logp) * mass[part] - counts[part]) / total
                grads[5] += hidden.T @ error
                grads[6] += error.sum(axis=0)
                back = (error @ self.weights[5].T) * (1 - hidden * hidden)
                grads[4] += back.sum(axis=0)
                for k in range(4):
                    grads[k] += hot[k][places[k][part]].T @ back
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.weights[k] -= rate * (1 - step / (rounds + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(loss / float(total))
        return losses


def contexts_of(hidden: np.ndarray, mass: np.ndarray, contexts: int, rounds: int = 20) -> np.ndarray:
    """A context for each window: k-means of their hidden layers, weighted by how often they occur."""
    centre = hidden[np.argsort(-mass, kind="stable")[:1]]
    while len(centre) < min(contexts, len(hidden)):  # next, the window that adds most to the error
        far = ((hidden[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1) * mass
        centre = np.concatenate([centre, hidden[[int(far.argmax())]]])
    for _ in range(rounds):
        near = (-2 * hidden @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        total = np.bincount(near, weights=mass, minlength=len(centre))
        sums = np.stack([np.bincount(near, weights=mass * x, minlength=len(centre)) for x in hidden.T], axis=1)
        centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centre)
    return near


@dataclass
class Model:
    """What scoring needs."""

    shape: Shape
    vocabulary: np.ndarray  # hashes of words, sorted
    classes: np.ndarray  # of entries
    table: np.ndarray  # log p(class | window)
    contexts: np.ndarray  # of windows
    shares: np.ndarray  # log p(entry | class, context)
    spelling: np.ndarray  # log p(byte | classes of the two before), of rare words

    def log_probs(self, entry: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each entry, given its window."""
        c = self.classes[entry].astype(np.int64)
        window = windows_of(c, counts, self.shape)
        return self.table[window, c].astype(np.float64) + self.shares[entry, self.contexts[window]]


def spelled(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of bytes, mixed with those after one byte's class and after none, and a little of any byte."""
    three = counts.reshape(BEHIND, BEHIND, 256).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p3, p2, p1 = ((x + 1e-9) / (x + 1e-9).sum(axis=-1, keepdims=True) for x in (three, two, one))
    return np.log(0.8 * p3 + 0.15 * p2[None] + 0.04 * p1[None, None] + 0.01 / 256).astype(np.float32).ravel()


def fit(docs: DataFrame, shape: Shape = Shape(), rounds: int = 120, least_share: float = 1e-6, smoothing: float = 10.0, scratch: Scratch | None = None) -> tuple[Model, DataFrame]:  # noqa: B008
    """The model, and the rows of entries that it was fitted on."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pseudo-likelihood")
    counted = word_counts(docs, scratch)
    is_word = F.col("kind") < RARE
    least = max(2.0, least_share * (counted.where(is_word).agg(F.sum("n")).first()[0] or 0))
    frequent = counted.where(is_word & (F.col("n") >= least)).select("key", "n").toArrow()  # at most 1 / least_share rows
    vocabulary, n = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(vocabulary)
    vocabulary, counts = vocabulary[order], np.concatenate([n[order], np.zeros(RARE, dtype=np.int64)])
    for r in counted.where(is_word & (F.col("n") < least)).groupBy("kind").agg(F.sum("n").alias("n")).collect():  # four rows
        counts[len(vocabulary) + r.kind] = r.n
    letters = counted.where(F.col("kind") == SPELLING).select("key", "n").toArrow()
    spelling = np.zeros(BEHIND * BEHIND * 256, dtype=np.int64)
    spelling[letters["key"].to_numpy()] = letters["n"].to_numpy()
    classes = assign_classes(counts, shape)
    chars = spelled(spelling)
    rows = entered(docs, spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(chars), scratch)
    sent = spark.sparkContext.broadcast(classes.astype(np.uint8))

    def window_codes(entry: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        c = sent.value[entry].astype(np.int64)
        return windows_of(c, sizes, shape) * shape.classes + c

    network = Network(shape)
    seen = summed(rows, window_codes, shape.windows * shape.classes).reshape(-1, shape.classes)
    network.train(seen, rounds)
    hidden, table = (np.concatenate(x) for x in zip(*(network.forward(np.arange(a, min(a + 8192, shape.windows))) for a in range(0, shape.windows, 8192)), strict=True))
    contexts = contexts_of(hidden, seen.sum(axis=1).astype(float), shape.contexts).astype(np.uint8)
    placed = spark.sparkContext.broadcast(contexts)

    def context_codes(entry: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return entry * shape.contexts + placed.value[windows_of(sent.value[entry].astype(np.int64), sizes, shape)]

    found = summed(rows, context_codes, len(counts) * shape.contexts).reshape(-1, shape.contexts)
    prior = (counts + 1) / np.bincount(classes, weights=counts + 1, minlength=shape.classes)[classes]
    of_class = np.stack([np.bincount(classes, weights=x, minlength=shape.classes) for x in found.T], axis=1)[classes]
    shares = np.log((found + smoothing * prior[:, None]) / (of_class + smoothing)).astype(np.float32)
    return Model(shape, vocabulary, classes.astype(np.uint8), table, contexts, shares, chars), rows


def score_documents(docs: DataFrame, shape: Shape = Shape(), rounds: int = 120, least_share: float = 1e-6) -> DataFrame:  # noqa: B008
    """doc_id, n_words, log_prob (the sum over the text's words) and score (the mean) of each row."""
    model, rows = fit(docs, shape, rounds, least_share)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, counts = entries_in(batch)
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=sent.value.log_probs(entry, counts), minlength=len(counts))
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts), pa.array(total + batch.column("spelt").to_numpy())], names=["doc_id", "n_words", "log_prob"])
        release_memory()

    out = rows.mapInArrow(run, "doc_id long, n_words long, log_prob double")
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
