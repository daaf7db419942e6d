"""Benchmark decontamination with an FM-index of each shard of the training texts.

A phrase is 13 consecutive words of a benchmark item, or the whole item if it has fewer words. A
task cuts its documents into shards and indexes each: suffix order by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every eighth word.
All phrases are searched backwards at once; occurrences are located by walking to a sampled
position; their spans are merged in each document.

Only words that some phrase holds get an id. Runs of such words that are shorter than the shortest
phrase cannot hold one, so they are left out of the index; nothing else is, so no occurrence is
lost. Items are taken in blocks of about `block_bytes` of text, each a pass over the documents, so what
is sent to the executors is bounded whatever the benchmark's size; with several blocks, documents are
numbered in a table first, and what the blocks find is joined by that number.

Defined results: null texts have no words; items without words have no phrase; an item_id that
occurs twice counts once; a null item_id is named as an empty string; an empty benchmark hits
nothing. Columns of `docs` other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, concat_ranges, raw_texts, release_memory

LENGTH = 13
#: A-Z to a-z; other ASCII but digits and letters to a space; all other bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "key long, doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, offsets array<struct<start:long,end:long>>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WaveletMatrix:
    """Ranks of symbols in an array, one level for each bit, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low, high = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            low, high = np.where(bit, zeros + ones[low], low - ones[low]), np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, low, here = (np.zeros(len(place), dtype=np.int64) for _ in range(3))
        here += place
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[here + 1] > ones[here]
            symbol = symbol << 1 | bit
            low, here = np.where(bit, zeros + ones[low], low - ones[low]), np.where(bit, zeros + ones[here], here - ones[here])
        return symbol, here - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order. Each 0 ends its run and is a symbol of its own, ordered by place."""
    n, ends = len(text), text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    step = 1
    while True:
        key = rank if step == 1 else first * n + then  # noqa: F821
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if new[order[-1]] == n - 1:
            return order
        rank = new
        # a suffix that has ended is alone in its rank already, so what stands behind its end is never compared
        first, then = rank, np.zeros(n, dtype=np.int64)
        then[: n - step] = rank[step:] if step < n else 0
        step *= 2


class FMIndex:
    """Search in a text of symbols; 0 ends a run, and no phrase holds it."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        order = suffix_order(text)
        n, most = len(text), int(text.max())
        self.n, self.matrix = n, WaveletMatrix(text[order - 1].astype(np.int64), max(1, most.bit_length()))
        self.less = np.zeros(most + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=most + 1), out=self.less[1:])
        kept = (order % sample == 0) | (text[order - 1] == 0)  # a walk never crosses the start of a run
        self.kept = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(kept, out=self.kept[1:])
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; rows of `phrases` are filled from the left."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, lengths[live] - back]
            known = symbol < len(self.less) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.less[symbol] + self.matrix.rank(symbol, low[live]), self.less[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, walked = np.zeros(len(rows), dtype=np.int64), 0
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            here = self.kept[rows + 1] > self.kept[rows]
            out[todo[here]] = self.places[self.kept[rows[here]]] + walked
            todo, rows = todo[~here], rows[~here]
            symbol, rank = self.matrix.at(rows)
            rows, walked = self.less[symbol] + rank, walked + 1
        return out


class Phrases:
    """The phrases of a block of items, with an id for each word."""

    def __init__(self, items: list[tuple[str, bytes]], length: int = LENGTH):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        windows, owners = [np.zeros((0, length), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            if len(ids):
                padded = np.concatenate([ids, np.zeros(max(0, length - len(ids)), dtype=np.int32)])
                windows.append(np.lib.stride_tricks.sliding_window_view(padded, length))
                owners.append(np.full(len(windows[-1]), number[name]))
        self.table, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        self.lengths = (self.table > 0).sum(axis=1).astype(np.int64)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
        self.items = pairs[:, 1]
        self.item_counts = np.bincount(pairs[:, 0], minlength=len(self.table))
        self.item_starts = np.cumsum(self.item_counts) - self.item_counts
        self.least = int(self.lengths.min(initial=length))


def runs_of(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of ids other than 0, of at least so many."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ids != 0, [False]]).astype(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    return start[length >= least], length[length >= least]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([new[1:], [True]])]


def search_shard(phrases: Phrases, ids: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """For each document: merged spans of words, and the items found. ids: word ids of each document, 0 for words in no phrase."""
    docs, places, pieces = [], [], []
    for k, x in enumerate(ids):
        start, length = runs_of(x, phrases.least)
        if len(start):
            docs.append(np.full(int(length.sum()) + len(start), k))
            where = concat_ranges(start, length + 1)
            places.append(where)
            pieces.append(np.append(x, 0)[where])
    none = np.zeros(0, dtype=np.int64)
    spans, items = [(none, none)] * len(ids), [none] * len(ids)
    if not docs or not len(phrases.lengths):
        return spans, items
    doc, place, text = map(np.concatenate, (docs, places, pieces))
    index = FMIndex(text)
    low, high = index.search(phrases.table, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    at = index.locate(concat_ranges(low, high - low))
    if not len(at):
        return spans, items
    order = np.argsort(doc[at], kind="stable")
    at, which = at[order], which[order]
    edges = np.flatnonzero(np.diff(doc[at], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(at)], strict=True):
        k, hit = int(doc[at[a]]), np.unique(which[a:b])
        spans[k] = merged(place[at[a:b]], place[at[a:b]] + phrases.lengths[which[a:b]])
        items[k] = np.unique(phrases.items[concat_ranges(phrases.item_starts[hit], phrases.item_counts[hit])])
    return spans, items


def _finder(sent, shard_words: int, shard_docs: int):
    """A task's work: documents to rows of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = sent.value
        get = phrases.vocabulary.get
        keys, names, ids, texts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            spans, items = search_shard(phrases, ids)
            counts = np.array([len(s) for s, _ in spans])
            starts, ends = (np.concatenate([x[i] for x in spans]) for i in (0, 1))
            offsets = [(m[0][a], m[1][b - 1]) for (s, e), text in zip(spans, texts, strict=True) if len(s) for m in [bounds(text)] for a, b in zip(s, e, strict=True)]
            pairs = lambda a, b: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], ["start", "end"]))
            hits = np.array([int((e - s).sum()) for s, e in spans])
            columns = [
                pa.array(keys, type=pa.int64()),
                pa.array(names, type=pa.int64()),
                pa.array([len(x) for x in ids], type=pa.int64()),
                pa.array(hits, type=pa.int64()),
                pairs(starts, ends),
                pairs([a for a, _ in offsets], [b for _, b in offsets]),
                pa.array([[phrases.names[i] for i in x] for x in items], type=pa.list_(pa.string())),
            ]
            return pa.record_batch(columns, names=["key", "doc_id", "n_words", "n_hit", "spans", "offsets", "items"])

        for batch in batches:
            for key, name, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                words = words_of(text)
                x = np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words))
                n = int(runs_of(x, phrases.least)[1].sum())
                keys.append(key)
                names.append(name)
                ids.append(x if n else np.zeros(len(words), dtype=np.int8))
                texts.append(text if n else b"")
                size += n
                if size >= shard_words or len(ids) >= shard_docs:
                    yield flush()
                    keys, names, ids, texts, size = [], [], [], [], 0
        if ids:
            yield flush()
        keys, names, ids, texts = [], [], [], []
        release_memory()

    return run


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in code points of the text."""
    spans = np.array([m.span() for m in WORD.finditer(text.decode())], dtype=np.int64).reshape(-1, 2)
    return spans[:, 0], spans[:, 1]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            for name in ("spans", "offsets"):
                start, end = (np.array([x[i] for x in row[name]], dtype=np.int64) for i in ("start", "end"))
                keep = merged(start, end)
                if name == "spans":
                    row["n_hit"] = int((keep[1] - keep[0]).sum())
                row[name] = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in keep), strict=True)]
            row["items"] = sorted(set(row["items"]))
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, block_bytes: int = 4 << 20, shard_words: int = 1 << 19, shard_docs: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of words), offsets (of code points, for removal) and items (sorted) of each document."""
    spark = docs.sparkSession
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks > 1:  # a number that is the same for all blocks
        rows = (scratch or Scratch(spark, "decontamination")).save(rows, "numbered")
    found = None
    for k in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Phrases([(x, y.encode()) for x, y in block.collect()], length))
        part = rows.mapInArrow(_finder(sent, shard_words, shard_docs), FOUND)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        lists = [F.flatten(F.collect_list(x)).alias(x) for x in ("spans", "offsets", "items")]
        found = found.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"), *lists)
        found = found.mapInArrow(_united, FOUND)
    return found.drop("key")
