"""Line dedup: maximal repeated runs of lines, from the LCP intervals of a suffix order over line ids.

Lines that hold a word get an id (a 64-bit hash of the line without outer white space); suffixes are
the lines of a document from some line on.

1. Prefix doubling: in round k the suffixes whose first 2^k lines occur more than once are ranked, by
   the ranks of their first and their second 2^(k-1) lines. A suffix that is alone in its class drops
   out, and rounds end when no run of that length repeats.
2. A class of round k holds LCP intervals of depths from 2^k to 2^(k+1) - 1. They are parted by going
   back through the rounds: in round j the members of an interval that agree in 2^j lines more become
   an interval of their own, and only their first (by doc_id, then place) stays behind to stand for
   them. In the end every suffix but the first of all lies in exactly one interval without being its
   first: the depth of that interval is the longest prefix that it shares with any earlier suffix.
3. That prefix is a repeated run, and the interval's first is its earliest copy. A run that another
   run of the document holds is left out, so those left are maximal. A run of `least_lines` lines or
   more is deleted if it has `least_words` words; a shorter one if it has `alone_words`, if that is given.
   Runs are never joined to reach a limit. A run that overlaps its own earlier copy ends where it begins.

Each deleted line has an earlier equal line, so the first copy of everything stays. Nothing grows
with the length of a run but the number of rounds (its logarithm); lines that never repeat are left
behind in the first one. Classes are aggregated before they are joined with their members, from
tables, so the rows of a class that very many documents share can be split over tasks.

Defined results: null and empty texts lose nothing; rows with the same doc_id and text are one
document, so both lose the same lines; a null doc_id ranks last; words are parted by ASCII white
space; an empty table gives an empty result; columns other than doc_id and text are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, raw_texts, release_memory

LAST = 2**63 - 1
#: Words of a line that op10 takes for a run by itself: as many as any run must have.
ALONE_WORDS = 10
SUFFIX = ["doc", "version", "place"]
FIRST = ["first_doc", "first_version", "first_place"]
RUNS = "doc long, version long, lines array<long>, n_words long, first_doc long"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc, version (a hash of the text), place among the lines with a word, line (its number), id, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places, numbers, ids, words = [], [], [], [], []
            for text in raw_texts(batch):
                n = 0
                for k, line in enumerate(text.split(b"\n")):
                    if line := line.strip():
                        places.append(n)
                        numbers.append(k)
                        ids.append(xxhash.xxh64_intdigest(line))
                        words.append(len(line.split()))
                        n += 1
                counts.append(n)
            which = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [batch.column("doc").take(which), batch.column("version").take(which), pa.array(places, type=pa.int64()), pa.array(numbers, type=pa.int64()), pa.array(np.array(ids, dtype=np.uint64).view(np.int64)), pa.array(words, type=pa.int64())]
            yield pa.record_batch(columns, names=["doc", "version", "place", "line", "id", "words"])
        release_memory()

    rows = docs.select(doc_rank(), version(), "text")
    return rows.mapInArrow(run, "doc long, version long, place long, line long, id long, words long")


def doc_rank() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")


def version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("version")


def is_first() -> Column:
    """Whether a suffix is the first of its class or interval."""
    return (F.col("doc") == F.col("first_doc")) & (F.col("version") == F.col("first_version")) & (F.col("place") == F.col("first_place"))


def with_first(suffixes: DataFrame, by: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Suffixes saved, and for each class of two or more its first."""
    suffixes = scratch.save(suffixes, f"{name}-members")
    found = suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*SUFFIX)).alias("low")).where("n > 1")
    return suffixes, scratch.save(found.select(*by, *(F.col(f"low.{x}").alias(y) for x, y in zip(SUFFIX, FIRST, strict=True))), f"{name}-first")


def classes(suffixes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of suffixes with a rank, those that share it with others, with the first of them."""
    suffixes, found = with_first(suffixes, ["rank"], scratch, name)
    out = scratch.save(suffixes.join(found, "rank"), name)
    scratch.drop(f"{name}-members")
    scratch.drop(f"{name}-first")
    return out


def doubled(level: DataFrame, by: int) -> DataFrame:
    """Suffixes of a level with the rank of twice its length."""
    second = level.select("doc", "version", (F.col("place") - by).alias("place"), F.col("rank").alias("then"))
    return level.select(*SUFFIX, "rank").join(second, SUFFIX).select(*SUFFIX, F.xxhash64("rank", "then").alias("rank"))


def parted(members: DataFrame, level: DataFrame, by: int, scratch: Scratch, name: str) -> DataFrame:
    """Members of intervals after one step back: those that agree in `by` lines more get an interval of their own."""
    then = level.select("doc", "version", F.col("place").alias("at"), F.col("rank").alias("then"))
    longer = members.withColumn("at", F.col("place") + F.col("length")).join(then, ["doc", "version", "at"], "left").drop("at")
    longer, found = with_first(longer.withColumnsRenamed({x: f"of_{x}" for x in FIRST}), ["node", "then"], scratch, name)
    both = longer.join(found, ["node", "then"], "left")
    stays = F.struct("node", "length", *(F.col(f"of_{x}").alias(x) for x in FIRST))
    goes = F.struct(F.xxhash64("node", "then", F.lit(by)).alias("node"), (F.col("length") + by).alias("length"), *FIRST)
    to = F.when(F.col("first_doc").isNull() | F.col("then").isNull(), F.array(stays)).when(is_first(), F.array(stays, goes)).otherwise(F.array(goes))
    out = scratch.save(both.select(*SUFFIX, F.explode(to).alias("to")).select(*SUFFIX, "to.*"), name)
    scratch.drop(f"{name}-members")
    scratch.drop(f"{name}-first")
    return out


def longest_copies(lines: DataFrame, scratch: Scratch, log=None) -> DataFrame:
    """The suffixes that share a line or more with an earlier one: the length of the longest such prefix, and the first suffix that has it.

    lines: SUFFIX and rank, a row for each suffix.
    """
    levels = [classes(lines, scratch, "level1")]
    while not levels[-1].isEmpty():
        by = 1 << (len(levels) - 1)
        if log:
            log("length", by, levels[-1].count())
        levels.append(classes(doubled(levels[-1], by), scratch, f"level{2 * by}"))
    levels.pop()
    if not levels:
        return lines.select(*SUFFIX, F.lit(1).alias("length"), *(F.col(x).alias(y) for x, y in zip(SUFFIX, FIRST, strict=True))).limit(0)
    tops = None
    for k, level in enumerate(levels):
        later = level.where(~is_first()).select(*SUFFIX, F.struct(F.lit(k).alias("k"), "rank", *FIRST).alias("top"))
        tops = later if tops is None else tops.unionByName(later)
    tops = scratch.save(tops.groupBy(*SUFFIX).agg(F.max("top").alias("top")).select(*SUFFIX, "top.*"), "tops")
    members = None
    for k in range(len(levels) - 1, 0, -1):
        own = tops.where(F.col("k") == k).select(*SUFFIX, F.xxhash64(F.lit(k), "rank").alias("node"), F.lit(1 << k).alias("length"), *FIRST)
        firsts = own.select("node", "length", *FIRST).distinct().select(*(F.col(y).alias(x) for x, y in zip(SUFFIX, FIRST, strict=True)), "node", "length", *FIRST)
        own = own.unionByName(firsts)
        members = parted(own if members is None else members.unionByName(own), levels[k - 1], 1 << (k - 1), scratch, f"parted{k}")
    out = tops.where("k = 0").select(*SUFFIX, F.lit(1).alias("length"), *FIRST)
    return out if members is None else out.unionByName(members.where(~is_first()).select(*SUFFIX, "length", *FIRST))


def repeated_runs(docs: DataFrame, least_lines: int = 2, least_words: int = 10, scratch: Scratch | None = None, log=None, alone_words: int | None = None) -> DataFrame:
    """doc, version, lines (numbers to delete), n_words and first_doc of each maximal repeated run that had an earlier copy."""
    scratch = scratch or Scratch(docs.sparkSession, "line-runs")
    lines = scratch.save(lines_of(docs), "lines")
    # a line that occurs once begins no repeated run and lies in none
    often = scratch.save(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "often")
    again = scratch.save(lines.join(often, "id", "left_semi").distinct(), "again")
    found = longest_copies(again.select(*SUFFIX, F.col("id").alias("rank")), scratch, log)
    own = (F.col("doc") == F.col("first_doc")) & (F.col("version") == F.col("first_version"))
    found = found.withColumn("length", F.when(own, F.least("length", F.col("place") - F.col("first_place"))).otherwise(F.col("length")))
    listed = found.join(again.select(*SUFFIX, "line", "words"), SUFFIX).groupBy("doc", "version")
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("place", "line", "words", "length", "first_doc"))).alias("s"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text_version, s in zip(batch.column("doc").to_pylist(), batch.column("version").to_pylist(), batch.column("s"), strict=True):
                place, line, words, length, first = (s.values.field(k).to_numpy() for k in range(5))
                before = np.concatenate([[0], np.cumsum(words)])
                # every line of a run has an earlier copy, so the run's rows follow one another
                at = np.arange(len(place))
                n_words = before[at + length] - before[at]
                enough = np.where(length >= least_lines, n_words >= least_words, (n_words >= alone_words) if alone_words is not None else False)
                reach = -1
                for k in np.flatnonzero(enough).tolist():
                    if place[k] + length[k] > reach:
                        reach = place[k] + length[k]
                        out.append((doc, text_version, line[k : k + length[k]].tolist(), int(n_words[k]), int(first[k])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True)], names=["doc", "version", "lines", "n_words", "first_doc"])
        release_memory()

    return listed.mapInArrow(runs, RUNS)


def line_dedup(docs: DataFrame, least_lines: int = 2, least_words: int = 10, most_broadcast: int = 2_000_000, scratch: Scratch | None = None, alone_words: int | None = None) -> DataFrame:
    """`docs` with the later copies of repeated runs deleted from `text`; documents of which no word is left go."""
    scratch = scratch or Scratch(docs.sparkSession, "line-runs")
    runs = scratch.save(repeated_runs(docs, least_lines, least_words, scratch, alone_words=alone_words), "runs")
    # a bound on what is broadcast: so many line numbers in all, counted
    few = (runs.agg(F.sum(F.size("lines"))).first()[0] or 0) <= most_broadcast
    gone = runs.groupBy(F.col("doc").alias("rank_of_doc"), F.col("version").alias("text_version")).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("deleted_lines"))
    row = docs.select(F.struct(*docs.columns).alias("row"), doc_rank().alias("rank_of_doc"), version().alias("text_version"))
    both = row.join(F.broadcast(gone) if few else gone.hint("merge"), ["rank_of_doc", "text_version"], "left")
    left = F.filter(F.split("row.text", "\n"), lambda x, k: ~F.array_contains("deleted_lines", k))
    text = F.when(F.col("deleted_lines").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    out = both.withColumn("new_text", text).where(F.col("deleted_lines").isNull() | F.col("new_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*(F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
