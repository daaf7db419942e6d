"""Toxicity of documents: a noisy-channel decoder restores disguised words, then a linear model scores.

1. A character language model (trigrams of 64 classes of lower-case characters) is counted over all texts.
2. Units that look disguised - digits, signs or separators among letters, letters or signs set apart,
   letters doubled or repeated - become lattices: a sign may stand for a letter or for itself, a run
   of separators may be nothing, a run of one letter, or of three signs or more, may be one or two letters. Viterbi decoding under the language
   model picks the restored text. Other units have one path through the lattice, themselves, and
   aren't decoded; nor, for scoring, are words with doubled letters of which no reading has a feature.
   Units of more than `PIECE` characters are decoded in pieces that overlap by more than a word, so time
   and memory are in proportion to the text, whatever it is.
3. Words of the restored text, and their beginnings, are features of a logistic model. It is fitted
   on labelled rows, of them on at most about `most_train` chosen by a hash of doc_id. Features are
   all that occur in `least_docs` of these texts and whose share of toxic ones is `least_told` standard
   errors or more from that of all; the penalty of the fit selects among them. Nothing else is
   sampled or bounded.

The score uses the text alone. Defined results: null and empty texts get the score of a text
without features; a null doc_id is never trained on; labels that are null are left out; without
labels of both kinds the model has no features; repeated rows are scored alike; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = 64
SPACE, DIGIT, SIGN, LETTER = 0, 59, 60, 61
#: What a character may stand for in a disguised word.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log-probabilities of the channel: a sign for a letter, a sign for itself, a separator put in, a run for one letter or for two.
AS_LETTER, AS_ITSELF, APART, RUN_ONE, RUN_TWO = -1.5, -4.0, -0.5, -0.7, -1.4

#: Longer units are cut into pieces of so many characters, each of which begins so many before the end of the last.
PIECE, OVERLAP = 128, 48

_letters = r"[^\W\d_]"
WORDS = re.compile(f"{_letters}+")
_signs = "@$!|+(€£"
_one, _apart = rf"(?:[^\W_]|[{_signs}])", rf"(?:[^\w{_signs}]|_)+"
SPACED = re.compile(rf"(?<![^\W_]){_one}(?:{_apart}{_one}){{2,}}(?![^\W_])")
BROKEN = re.compile(rf"(?:{_letters}{_apart}{_one}|{_one}{_apart}{_letters})")
DISGUISED = re.compile(rf"\S*(?:{_letters}[0-9@$!|+(€£]|[0-9@$|+(€£]{_letters})\S*|[^\W_]*({_letters})\1[^\W_]*")
REPEATED = re.compile(r"(.)\1")
RUNS = re.compile(r"(.)\1+")
TAIL = re.compile(r"[!.,;:?\"')*#%&]+$|\${3,}\W*$")


def class_table() -> np.ndarray:
    """The class of each code point below 256; others are letters."""
    table = np.full(257, SIGN, dtype=np.int64)
    for c in range(256):
        ch = chr(c)
        if ch.isspace():
            table[c] = SPACE
        elif ch.isdigit():
            table[c] = DIGIT
        elif "a" <= ch <= "z":
            table[c] = 1 + c - 97
        elif 0xE0 <= c <= 0xFF and c != 0xF7:
            table[c] = 27 + c - 0xE0
        elif ch.isalpha():
            table[c] = LETTER
    table[256] = LETTER
    return table


TABLE = class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return TABLE[np.minimum(points, 256)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all trigrams of classes in all texts, each text between two spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            text = "  ".join(x for x in batch.column("text").to_pylist() if x)
            c = classes_of(f"  {text}  ")
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code), pa.array(total[code])], names=["code", "n"])

    # as many rows as there are trigrams of classes, whatever the input
    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CLASSES**3, dtype=np.int64)
    total[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return total


def language_model(counts: np.ndarray, weights: tuple[float, float, float] = (0.75, 0.2, 0.05)) -> np.ndarray:
    """Log-probability of each class after two others: trigrams, mixed with bigrams and single classes."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1)) + 1
    p3, p2 = ((x + 1e-9) / (x + 1e-9).sum(axis=-1, keepdims=True) for x in (three, two))
    return np.log(weights[0] * p3 + weights[1] * p2[None] + weights[2] * (one / one.sum())[None, None]).astype(np.float32)


def pieces_of(unit: str) -> list[str]:
    if len(unit) <= PIECE:
        return [unit]
    return [unit[k : k + PIECE] for k in range(0, len(unit) - OVERLAP, PIECE - OVERLAP)]


def separates(ch: str) -> bool:
    return not ch.isalnum() and ch not in STANDS_FOR


def lattice(unit: str, spaced: bool) -> list[list[tuple[int, str, float]]]:
    """For each place of a unit: where an edge leads, what it writes, and its log-probability."""
    edges: list[list[tuple[int, str, float]]] = []
    for k, ch in enumerate(unit):
        here = []
        if ch.isalpha():
            here.append((k + 1, ch, 0.0))
            end = k
            while end < len(unit) and unit[end] == ch:
                end += 1
            if end - k > 1 and (k == 0 or unit[k - 1] != ch):
                if end - k > 2:
                    here = [(end, ch * 2, RUN_TWO)]
                here.append((end, ch, RUN_ONE))
        else:
            if spaced and separates(ch):
                end = k + 1
                while end < len(unit) and separates(unit[end]):
                    end += 1
                here += [(end, "", APART), (end, " ", 2 * APART)]
            else:
                here += [(k + 1, x, AS_LETTER) for x in STANDS_FOR.get(ch, "")]
                here.append((k + 1, ch, AS_ITSELF))
                end = k + len(unit[k:]) - len(unit[k:].lstrip(ch))
                if end > k + 2 and (k == 0 or unit[k - 1] != ch):
                    here += [(end, x * n, AS_LETTER + cost) for x in STANDS_FOR.get(ch, "") for n, cost in ((1, RUN_ONE), (2, RUN_TWO))]
        edges.append(here)
    return edges


class Decoder:
    """Viterbi over states of place and the last two classes written."""

    def __init__(self, model: np.ndarray, most: int = 200_000, wanted=None):
        self.model, self.most, self.known, self.wanted = model, most, {}, wanted

    def decode(self, unit: str, spaced: bool) -> str:
        model, edges = self.model, lattice(unit, spaced)
        best: list[dict] = [{} for _ in range(len(unit) + 1)]
        best[0][(SPACE, SPACE)] = (0.0, None, "")
        for k in range(len(unit)):
            for state, (score, _, _) in best[k].items():
                for end, written, cost in edges[k]:
                    (a, b), total = state, score + cost
                    for ch in written:
                        c = int(TABLE[min(ord(ch), 256)])
                        total += float(model[a, b, c])
                        a, b = b, c
                    if (a, b) not in best[end] or total > best[end][(a, b)][0]:
                        best[end][(a, b)] = (total, (k, state), written)
        at = (len(unit), max(best[-1], key=lambda s: best[-1][s][0] + float(model[s[0], s[1], SPACE])))
        out = []
        while at is not None and at[0]:
            _, back, written = best[at[0]][at[1]]
            out.append(written)
            at = back
        return "".join(reversed(out))

    def restored(self, unit: str) -> list[str]:
        """The words that a unit of a text stands for."""
        if (found := self.known.get(unit)) is None:
            if len(self.known) > self.most:
                self.known.clear()
            spaced = SPACED.fullmatch(unit) is not None
            core = unit if spaced else TAIL.sub("", unit)
            spaced = spaced or BROKEN.search(core) is not None
            found = self.known[unit] = WORDS.findall(self.decode(core, spaced)) if core else []
        return found

    def of_token(self, token: str) -> list[str]:
        """Words of a token (what stands between white space), with those that it stands for if it is disguised."""
        if len(token) > PIECE:
            return [w for x in pieces_of(token) for w in self.of_token(x)]
        if token.isalpha() and not REPEATED.search(token):
            return [token]
        words = WORDS.findall(token)
        for unit in [token] if BROKEN.search(TAIL.sub("", token)) else [m.group() for m in DISGUISED.finditer(token)]:
            if self.wanted is None or not unit.isalpha() or self.wanted(unit):
                words += self.restored(unit)
        return words

    def of_spaced(self, text: str) -> list[str]:
        return [w for m in SPACED.finditer(text) for x in pieces_of(m.group()) if WORDS.search(x) for w in self.restored(x)]

    def words(self, text: str) -> set[str]:
        """Words of a text in lower case, with those that disguised units stand for."""
        text = text.lower()
        return {w for token in set(text.split()) for w in self.of_token(token)}.union(self.of_spaced(text))


def features_of(word: str) -> list[str]:
    return [word] + [f"{word[:k]}-" for k in (4, 5) if len(word) > k]


def single(word: str) -> str:
    """A word with one letter for each run."""
    return RUNS.sub(r"\1", word)


class Scorer:
    def __init__(self, model: np.ndarray, weights: dict[str, float], bias: float, most: int = 1_000_000):
        self.decoder, self.weights, self.bias, self.most = Decoder(model, wanted=self.may_have), weights, bias, most
        self.single = {single(x) for x in weights}
        self.known: dict[str, tuple[str, ...]] = {}

    def may_have(self, word: str) -> bool:
        """Whether any reading of a word's runs can have a feature: all readings are alike with single letters."""
        bare, known = single(word), self.single
        return bare in known or any(f"{bare[:k]}-" in known for k in range(1, 6))

    def picked(self, words: list[str]) -> tuple[str, ...]:
        weights = self.weights
        return tuple(x for w in words for x in features_of(w) if x in weights)

    def features(self, text: str) -> set[str]:
        """The model's features in a text; those of a token are looked up once."""
        text, known = text.lower(), self.known
        found = set(self.picked(self.decoder.of_spaced(text)))
        for token in set(text.split()):
            if (own := known.get(token)) is None:
                if len(known) > self.most:
                    known.clear()
                own = known[token] = self.picked(self.decoder.of_token(token))
            if own:
                found.update(own)
        return found

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.bias + sum(sorted(self.weights[x] for x in self.features(text)))))))


class _Sent:
    """A broadcast model that a worker builds its scorer from once."""

    def __init__(self, sent, key: str):
        self.sent, self.key = sent, key

    def scorer(self) -> Scorer:
        return _cached(self.key, lambda: Scorer(*self.sent.value))


_scorers: dict[str, Scorer] = {}


def _cached(key: str, make) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = make()
    return _scorers[key]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_logistic(rows: list[list[int]], labels: np.ndarray, n: int, decay: float = 0.01, sparse: float = 0.3, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model over sets of features, by accelerated gradient steps on the loss with both penalties.

    `sparse` prefers few features that many rows share to the many that copies of one row share.
    """
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    feature = np.array([x for row in rows for x in row], dtype=np.int64)

    def product(w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(at, weights=w[feature], minlength=len(rows))

    def gradient(error: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(feature, weights=error[at], minlength=n), float(error.sum())

    w, bias, curve = np.ones(n), 1.0, 1.0
    for _ in range(20):  # the steepest curvature, by power iteration
        w, bias = gradient(product(w, bias))
        curve = math.sqrt(float(w @ w) + bias * bias)
        w, bias = w / curve, bias / curve
    step = 1 / (0.25 * 1.1 * curve + decay)
    w, m, bias, bm = np.zeros(n), np.zeros(n), 0.0, 0.0
    old, old_bias = w, bias
    for k in range(rounds):
        dw, db = gradient(1 / (1 + np.exp(-np.clip(product(m, bm), -50, 50))) - labels)
        w, bias = m - step * (dw + decay * m), bm - step * db
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        pull = k / (k + 3)
        m, bm = w + pull * (w - old), bias + pull * (bias - old_bias)
        old, old_bias = w, bias
    return w, float(bias)


def toxicity(docs: DataFrame, labels: DataFrame, most_train: int = 16_000, least_told: float = 2.5, least_docs: int = 4) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`. labels: doc_id, toxic."""
    spark = docs.sparkSession
    model = language_model(trigram_counts(docs))
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    train = train.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = train.count()
    if n > most_train:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_train / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(train), "doc_id")  # at most about most_train rows
    texts = texts.select("toxic", "text", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"]).drop("h")
    bare = _Sent(spark.sparkContext.broadcast((model, {}, 0.0)), f"words-{uuid.uuid4()}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, n, bad = bare.scorer().decoder, Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = {x for w in decoder.words(text or "") for x in features_of(w)}
                n.update(found)
                if toxic:
                    bad.update(found)
        yield pa.record_batch([pa.array(list(n), type=pa.string()), pa.array(list(n.values()), type=pa.int64()), pa.array([bad[x] for x in n], type=pa.int64())], names=["f", "n", "bad"])

    sizes = texts.groupBy("toxic").count().collect()
    total = sum(r["count"] for r in sizes)
    share = sum(r["count"] for r in sizes if r.toxic) / total if total else 0.0
    chosen: list[str] = []
    if 0 < share < 1:
        seen = texts.mapInArrow(counted, "f string, n long, bad long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= least_docs)
        told = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        chosen = sorted(seen.where(F.abs(told) >= least_told).select("f").toArrow()["f"].to_pylist())
    place = {x: k for k, x in enumerate(chosen)}
    picked = _Sent(spark.sparkContext.broadcast((model, place, 0.0)), f"picked-{uuid.uuid4()}")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = picked.scorer()
        for batch in batches:
            found = [sorted(map(scorer.weights.__getitem__, scorer.features(x or ""))) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, type=pa.list_(pa.int32()))], names=["toxic", "features"])

    weights, bias = {}, 0.0
    if chosen:
        rows = texts.mapInArrow(rows_of, "toxic int, features array<int>").toArrow()  # at most about most_train rows of numbers
        rows = sorted(zip(map(tuple, rows["features"].to_pylist()), (int(bool(x)) for x in rows["toxic"].to_pylist()), strict=True))
        w, bias = fit_logistic([list(x) for x, _ in rows], np.array([y for _, y in rows], dtype=float), len(chosen))
        weights = dict(zip(chosen, w.tolist(), strict=True))
    fitted = _Sent(spark.sparkContext.broadcast((model, weights, bias)), f"fitted-{uuid.uuid4()}")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = fitted.scorer()
        for batch in batches:
            scores = [scorer.score(x or "") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
