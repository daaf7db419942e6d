"""Removal of passages that stand in an earlier document, by hashing lines and parts of lines.

1. Words are what stands between white space, compared without letter case and the marks around them;
   words of more than `CHARACTERS` characters (scripts without spaces) are cut into pieces.
2. A unit begins with each line, with each piece of a long word and behind it, and at words chosen by
   their hash: the least of each `WINDOW` words in a row. The choice depends on these words alone, so a
   passage falls into the same units wherever it stands, but for less than `WINDOW` words at either end.
3. Hashed are the lines that weigh `least_words`, and the runs of `UNITS` units, taken on to
   `least_words` where they weigh less, from each unit forwards and backwards. A word weighs one, a
   piece of a long word one for each six characters. Digests have 96 bits.
4. Digests are grouped over all documents: the occurrence of lowest rank (doc_id, hash of the text,
   then offset) stays, and every other is a span of its document, merged with its neighbours.
   Offsets are code points of the original text.

A task keeps of each digest only the lowest occurrence it has met; the others are known to be later
ones, so they are spans at once. What is left is packed by buckets of digests and shuffled once. A
digest that a third of all documents hold is thus one entry for each flush of a task, and the number of
buckets follows from the size of all texts, so a bucket's size is bounded.

Defined results: null, empty and short texts lose nothing; texts that share a doc_id are documents of
their own, told apart by `text_hash`; rows with the same doc_id and text are copies: the first (copy 0)
is one document, the others are spans of their whole text if it has a word; a null doc_id ranks last;
an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, release_memory
from tessel.llm.superminhash import GOLDEN, mix

#: Of so many words in a row, or characters of a word longer than that, one begins a unit.
WINDOW, CHARACTERS = 12, 48
#: Units of a run.
UNITS = 3
#: Marks around a word that say nothing.
MARKS = string.punctuation + "‘’“”„«»…–—、。，！？：；।۔؟"
LAST = 2**63 - 1
SPACES = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: Odd multipliers of the two digests, with their inverses modulo 2^64.
BASES = tuple((x, pow(x, -1, 2**64)) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
SPANS = "doc long, version long, start int, end int"
#: Fields of an occurrence, one after the other in a packed bucket.
FIELDS = (("a", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("b", "<u4"), ("start", "<i4"), ("end", "<i4"))
ENTRY = sum(np.dtype(x).itemsize for _, x in FIELDS)


class WordHashes(dict):
    """64-bit hashes of words without case and marks; emptied when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        low = word.lower()
        self[word] = found = xxhash.xxh64_intdigest((low.strip(MARKS) or low).encode()) or 1
        return found


_hashes = WordHashes()


def sliding(x: np.ndarray, window: int, least) -> np.ndarray:
    """np.minimum or np.maximum over each `window` values in a row."""
    size = 1
    while 2 * size <= window:
        x, size = least(x[:-size], x[size:]), 2 * size
    return least(x[: len(x) - (window - size)], x[window - size :]) if size < window else x


def chosen(x: np.ndarray, window: int) -> np.ndarray:
    """Whether each value is the least of some `window` values in a row; a 0 lets none that hold it choose."""
    if len(x) < window:
        return np.zeros(len(x), dtype=bool)
    low, pad = sliding(x, window, np.minimum), np.zeros(window - 1, dtype=x.dtype)
    return (sliding(np.concatenate([pad, low, pad]), window, np.maximum) == x) & (x > 0)


def pieces_of(points: np.ndarray) -> np.ndarray:
    """Where the pieces of a long word begin: at runs of four characters chosen by their hash. Case folds for ASCII letters only."""
    c = points.astype(np.uint64)
    c += np.where((c >= 65) & (c <= 90), np.uint64(32), np.uint64(0))
    grams = c[:-3]
    for k in range(1, 4):
        grams = mix(grams * GOLDEN + c[k : len(c) - 3 + k])
    cut = np.flatnonzero(chosen(np.maximum(grams, np.uint64(1)), CHARACTERS - 3))
    return np.unique(np.append(cut, 0))


def occurrences(texts: list[str], least_words: int) -> tuple[np.ndarray, ...]:
    """Number of the text, digest (64 and 32 bits), start and end of everything that is hashed, by text and start."""
    joined = "\n".join(texts)
    base = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
    points = np.frombuffer(joined.encode(), dtype=np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    space = SPACES[points] if points.itemsize == 1 else SPACES[np.minimum(points, len(SPACES) - 1)]
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends, words = edges[::2], edges[1::2], joined.split()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    weight, piece = np.ones(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
    if len(long := np.flatnonzero(ends - starts > CHARACTERS)):
        begin = [starts[k] + pieces_of(points[starts[k] : ends[k]]) for k in long]
        stop = [np.append(x[1:], ends[k]) for x, k in zip(begin, long, strict=True)]
        begin, stop = np.concatenate(begin), np.concatenate(stop)
        own = np.array([_hashes[joined[a:b]] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
        starts, ends = np.concatenate([np.delete(starts, long), begin]), np.concatenate([np.delete(ends, long), stop])
        h, weight = np.concatenate([np.delete(h, long), own]), np.concatenate([np.delete(weight, long), np.maximum(1, (stop - begin) // 6)])
        order = np.argsort(starts, kind="stable")
        piece = order >= len(piece) - len(long)
        starts, ends, h, weight = starts[order], ends[order], h[order], weight[order]
    n = len(h)
    if not n:
        return tuple(np.zeros(0, dtype=x) for x in (np.int64, np.uint64, np.uint32, np.int64, np.int64))
    doc = np.searchsorted(base, starts, side="right") - 1
    fresh = np.diff(np.searchsorted(np.flatnonzero(points == 10), starts), prepend=-1) != 0  # texts are lines apart
    at = np.arange(n) + np.cumsum(np.diff(doc, prepend=-1) != 0)
    apart = np.zeros(n + len(texts) + 1, dtype=np.uint64)  # a 0 between texts and for pieces
    apart[at] = np.where(piece, 0, h)
    # units, and the weight before each of their borders
    piece[1:] |= piece[:-1]
    border = np.append(np.flatnonzero(fresh | piece | chosen(apart, WINDOW)[at]), n)
    before = np.concatenate([[0], np.cumsum(weight)])[border]
    unit_doc, k = doc[border[:-1]], np.arange(len(border) - 1)
    first, last = np.searchsorted(unit_doc, unit_doc), np.searchsorted(unit_doc, unit_doc, side="right")
    to, since = np.searchsorted(before, before[:-1] + least_words), np.searchsorted(before, before[1:] - least_words, side="right") - 1
    line = np.append(np.flatnonzero(fresh[border[:-1]]), len(k))
    whole = before[line[1:]] - before[line[:-1]] >= least_words
    runs = [(k, np.minimum(np.maximum(to, k + UNITS), last), to <= last), (np.maximum(np.minimum(since, k + 1 - UNITS), first), k + 1, since >= first), (line[:-1], line[1:], whole)]
    code = np.unique(np.concatenate([(a * len(border) + b)[ok] for a, b, ok in runs]))
    low, high = border[code // len(border)], border[code % len(border)]
    digests = []
    with np.errstate(over="ignore"):
        for number, (factor, inverse) in enumerate(BASES):
            powers, back = (np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(n, x, dtype=np.uint64))) for x in (factor, inverse))
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((mix(h + np.uint64(number)) if number else h) * powers[:-1], dtype=np.uint64)])
            digests.append(mix((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64) * GOLDEN))
    owner = doc[low]
    return owner, digests[0], (digests[1] >> np.uint64(32)).astype(np.uint32), starts[low] - base[owner], ends[high - 1] - base[owner]


def later(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences sorted by digest, then rank: the first of each digest, and those that aren't (nor a copy of the first)."""
    if not len(x["a"]):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.concatenate([[True], (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])])
    first = np.flatnonzero(new)
    of = first[np.cumsum(new) - 1]
    other = np.logical_or.reduce([x[y] != x[y][of] for y in ("doc", "version", "start")])
    return first, np.flatnonzero(other)


def merged(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Spans joined where they overlap or touch, by document."""
    order = np.lexsort((x["start"], x["version"], x["doc"]))
    x = {y: z[order] for y, z in x.items()}
    apart = np.cumsum(np.concatenate([[0], (x["doc"][1:] != x["doc"][:-1]) | (x["version"][1:] != x["version"][:-1])])) << 32
    start, reach = x["start"] + apart, np.maximum.accumulate(x["end"] + apart)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    last = np.append(first[1:], len(start)) - 1
    return {"doc": x["doc"][first], "version": x["version"][first], "start": x["start"][first], "end": reach[last] - apart[last]}


def spans_batch(x: dict[str, np.ndarray], which: np.ndarray) -> list[pa.Array]:
    return [pa.array(x["doc"][which]), pa.array(x["version"][which]), pa.array(x["start"][which].astype(np.int32)), pa.array(x["end"][which].astype(np.int32))]


def _gathered(least_words: int, buckets: int, flush_at: int, batch_chars: int):
    """Texts to packed buckets of occurrences (payload), and spans that are known at once (negative buckets, by document)."""

    def flush(parts: list[dict]) -> Iterator[pa.RecordBatch]:
        x = {y: np.concatenate([p[y] for p in parts]) for y, _ in FIELDS}
        # by rank, then, in a way that leaves equal ones so, by digest
        order = np.lexsort((x["start"], x["version"], x["doc"]))
        order = order[np.argsort(x["a"][order], kind="stable")]
        x = {y: z[order] for y, z in x.items()}
        first, rest = later(x)
        names = ["bucket", "payload", "doc", "version", "start", "end"]
        if len(rest):
            found = merged({y: x[y][rest] for y in ("doc", "version", "start", "end")})
            own = mix(found["doc"].view(np.uint64) ^ found["version"].view(np.uint64)) % np.uint64(buckets)
            yield pa.record_batch([pa.array(-1 - own.astype(np.int32)), pa.nulls(len(own), pa.binary()), *spans_batch(found, np.arange(len(own)))], names=names)
        bucket = (x["a"][first] % np.uint64(buckets)).astype(np.int32)
        first = first[np.argsort(bucket, kind="stable")]
        found, sizes = np.unique(bucket, return_counts=True)
        cuts = np.cumsum(sizes)[:-1]
        fields = [np.split(x[y][first].astype(kind), cuts) for y, kind in FIELDS]
        for a in range(0, len(found), 256):
            rows = range(a, min(a + 256, len(found)))
            packed = pa.array([b"".join(f[k].tobytes() for f in fields) for k in rows], type=pa.binary())
            yield pa.record_batch([pa.array(found[a : a + 256]), packed, *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            names, versions = (np.asarray(batch.column(x)) for x in ("doc", "version"))
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            for group in np.split(np.arange(len(texts)), np.unique(np.searchsorted(ends, np.arange(batch_chars, int(ends[-1]), batch_chars)))) if texts else ():
                if not len(group):
                    continue
                owner, a, b, start, end = occurrences([texts[k] for k in group], least_words)
                owner = group[owner]
                parts.append({"a": a, "b": b, "doc": names[owner], "version": versions[owner], "start": start, "end": end})
                size += len(a)
                if size >= flush_at:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)
        _hashes.clear()
        release_memory()

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket to spans."""
    bucket, payloads = None, []

    def spans() -> pa.RecordBatch:
        x, at = {}, 0
        sizes = [len(p) // ENTRY for p in payloads]
        for y, kind in FIELDS:
            width = np.dtype(kind).itemsize
            x[y] = np.concatenate([np.frombuffer(p, dtype=kind, count=n, offset=at * n) for p, n in zip(payloads, sizes, strict=True)])
            at += width
        order = np.argsort(x["a"], kind="stable")
        a = x["a"][order]
        twice = np.concatenate([[False], a[1:] == a[:-1]])
        order = order[twice | np.concatenate([twice[1:], [False]])]
        order = order[np.lexsort([x[y][order] for y in ("start", "version", "doc", "b", "a")])]
        x = {y: z[order] for y, z in x.items()}
        return pa.record_batch(spans_batch(x, later(x)[1]), names=["doc", "version", "start", "end"])

    for batch in batches:
        at_once = batch.filter(pc.less(batch.column("bucket"), 0))
        if len(at_once):
            yield at_once.select(["doc", "version", "start", "end"])
        for k, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
            if k < 0:
                continue
            if k != bucket and payloads:
                yield spans()
                payloads = []
            bucket = k
            payloads.append(payload.as_buffer())
    if payloads:
        yield spans()
    release_memory()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, starts, ends, counts = [], [], [], []
        for s in batch.column("s"):
            start, end = (s.values.field(k).to_numpy() for k in range(2))
            reach = np.maximum.accumulate(end)
            new = np.concatenate([[True], start[1:] > reach[:-1]])
            starts.append(start[new])
            ends.append(reach[np.concatenate([new[1:], [True]])])
            counts.append(int(new.sum()))
        which = pa.array(np.repeat(np.arange(len(counts)), counts))
        docs = [batch.column(x).take(which) for x in ("doc", "version")]
        none = [np.zeros(0, dtype=np.int32)]
        yield pa.record_batch([*docs, pa.array(np.concatenate(none + starts)), pa.array(np.concatenate(none + ends))], names=["doc", "version", "start", "end"])


def repeated_spans(docs: DataFrame, least_words: int = 16, bucket_bytes: int = 16 << 20, flush_at: int = 1 << 20, batch_chars: int = 2 << 20, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_hash, copy, start and end of each span to remove. bucket_bytes: of text, for each bucket of digests."""
    scratch = scratch or Scratch(docs.sparkSession, "unit-dedup")
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
    rows = scratch.save(named.select("doc", "version", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("any")), "rows")
    buckets = -(-(rows.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes) * 8 + 8
    packed = named.mapInArrow(_gathered(least_words, buckets, flush_at, batch_chars), f"bucket int, payload binary, {SPANS}")
    spans = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_grouped, SPANS)
    listed = spans.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    out = listed.mapInArrow(_merged, SPANS).withColumn("copy", F.lit(0).cast("long"))
    copies = rows.where("any").groupBy("doc", "version", "chars").agg(F.count("*").alias("n")).where("n > 1")
    copies = copies.select("doc", "version", F.lit(0).alias("start"), F.col("chars").alias("end"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("copy"))
    out = out.unionByName(copies)
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), F.col("version").alias("text_hash"), "copy", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without its spans; what is left on a line keeps its place."""
    at, out = 0, []
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
