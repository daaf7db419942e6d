"""Quality rules of documents, with failure rates of hosts shrunk by an empirical beta prior.

Everything is DataFrame functions; the only thing that reaches the driver is the prior (two numbers).

1. Each text gives counts: words, symbols, repeated lines, words in repeated 8-word windows.
2. Hard rules reject a document by itself. Soft rules are only counted.
3. Failures are aggregated by host. The rates of all hosts give a beta prior by moments; a host's
   shrunk rate is its posterior mean, so a host with few documents stays near the mean of all.
4. A host whose shrunk rate exceeds `most_failing` is strict: of it, documents that break a soft
   rule are rejected too. A document that breaks no rule is kept whatever its host.

Defined results: a null or empty text has no words and breaks the length rule; a null source is a
host of its own; rows with a null or a repeated doc_id, or equal in all, count each; an empty table
gives an empty result. Windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, joined

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_of(source: Column) -> Column:
    """The host of a URL, or the name itself, in lower case; empty for null."""
    return F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def counted(docs: DataFrame, *carry: str) -> DataFrame:
    """A row for each document: `row` with the columns named in `carry`, host, and the five counts."""
    df = docs.select(F.struct(*carry).alias("row"), host_of(F.col("source").cast("string")).alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    words = F.filter(F.split("t", f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.select("row", "host", words.alias("w"), lines.alias("l"), (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    df = df.select(
        "row",
        "host",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    step = 1
    while step < WINDOW:  # hashes of 1, 2, 4, 8 words
        n = F.greatest(F.size("h") - step, F.lit(0))
        df = df.withColumn("h", F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    repeated = F.expr(f"""
        aggregate(
          transform(
            transform(
              array(array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))),
              s -> sort_array(filter(transform(s, (x, i) -> if(get(s, i - 1).h = x.h or get(s, i + 1).h = x.h, x.i, null)), p -> p is not null))
            )[0],
            p -> p
          ),
          named_struct('n', 0L, 'end', 0L),
          (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(a.end, cast(p as bigint)), 'end', cast(p + {WINDOW} as bigint)),
          a -> a.n
        )""")
    return df.select("row", "host", *COUNTS[:4], F.when(F.size("h") > F.size(F.array_distinct("h")), repeated).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def ruled(counts: DataFrame, least_words: int = 20, most_repeat: int = 30, most_symbols: int = 10, most_dup_lines: int = 10) -> DataFrame:
    """base_failed by the hard rules; failed by any rule. Limits are percentages of words, of word characters and of words for each repeated line."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > most_symbols * F.col("word_chars")) | (100 * F.col("n_dup_lines") > most_dup_lines * F.col("n_words"))
    return counts.withColumns({"base_failed": base, "failed": base | soft})


def host_rates(rules: DataFrame) -> DataFrame:
    """host, n, n_failed and rate: the posterior mean under the beta prior that the hosts' own rates suggest."""
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    mean, spread, inner = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    alpha, beta = beta_prior(mean or 0.0, spread or 0.0, inner or 1.0)
    return hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n") + alpha + beta))


def beta_prior(mean: float, spread: float, inner: float, least: float = 2.0, most: float = 1e4) -> tuple[float, float]:
    """Beta parameters by moments. spread: variance of the rates; inner: mean of 1 / n, for what sampling adds to it."""
    within = mean * (1 - mean)
    between = spread - within * inner
    strength = min(max(within / between - 1, least), most) if between > 0 else most
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, *carry: str, most_failing: float = 0.5, most_hosts: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """`row` (the carried columns), host, the counts, base_failed, failed, host_strict and kept of each document. Strict hosts are broadcast if they are at most `most_hosts`."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    rules = scratch.save(ruled(counted(docs, *(carry or docs.columns))), "rules")
    # written before it is joined, so that beyond the broadcast both sides are plain shuffles and a hot host's rows can be split
    strict = scratch.save(host_rates(rules).where(F.col("rate") > most_failing).select("host", F.lit(True).alias("strict")), "strict")
    out = joined(rules, strict, ["host"], "left", most_hosts).withColumn("host_strict", F.coalesce("strict", F.lit(False))).drop("strict")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_strict") & F.col("failed")))
