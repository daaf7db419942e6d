"""Near-duplicate groups: SuperMinHash signatures, bands, verification on whole sets, union-find.

1. A text's set holds its distinct runs of five words (64-bit hashes of them). Documents with the
   same set, by a 128-bit fingerprint, are one class; its least doc_id stands for it.
2. 128 registers in 32 bands of 4 make two sets of similarity 0.75 meet in some band with
   probability 1 - (1 - 0.75^4)^32 > 0.99999.
3. A band that several classes share is a bucket. Buckets aren't expanded into pairs: each member
   is compared with the bucket's centre, the member that shares bands with most others, and the two
   are linked if they are similar.
4. Members of buckets that are still in different components (unlike texts that share a passage,
   edges of a group) are searched for the pairs that are left by prefix filtering, which is exact:
   similar sets share one of their rarest quarter of elements. Only elements that lie in two
   components give pairs, and of those the members of the larger component aren't paired among
   themselves.
5. Links are confirmed on the full sets, and grouped by union-find.

Defined results: null and empty texts, or texts of white space, have an empty set and stand alone;
rows that share a doc_id are one node, linked with whatever any of their texts is like; a null doc_id
is linked with nothing and kept; ties take the least doc_id. Other columns are ignored.

Tables that are aggregated by a key are written before they are joined by it, so that both sides of
the join are plain shuffles and the rows of a hot key can be split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Scratch, flat_binary, flat_lists, raw_texts, release_memory
from tessel.llm.components import components
from tessel.llm.superminhash import band_hashes, forget, mix, shingle_set, signatures


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set in two longs, and the hash of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in raw_texts(batch)]
            counts = np.array([len(x) for x in sets], dtype=np.int64)
            table = signatures(np.concatenate(sets), counts, bands * rows)
            with np.errstate(over="ignore"):
                prints = [np.array([[x.sum(), np.bitwise_xor.reduce(mix(x))] for x in sets], dtype=np.uint64).view(np.int64)]
            found = band_hashes(table, rows)[counts > 0]
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(prints[0][:, 0]), pa.array(prints[0][:, 1]), flat_lists(found.ravel(), np.where(counts > 0, bands, 0), pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "fa", "fb", "bands"])
        forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, fa long, fb long, bands array<long>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in raw_texts(batch)]
            with np.errstate(over="ignore"):
                prints = np.array([x.sum() for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints), flat_binary(b"".join(x.tobytes() for x in sets), np.array([8 * len(x) for x in sets]))], names=["id", "fa", "set"])
        forget()

    return docs.mapInArrow(run, "id long, fa long, set binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common and either: the sizes of the two sets' intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                if len(x) < len(y):
                    x, y = y, x
                at = np.searchsorted(x, y)
                n = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                common.append(n)
                either.append(len(x) + len(y) - n)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(common, type=pa.int64()), pa.array(either, type=pa.int64())], names=["a", "b", "common", "either"])
        release_memory()

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, common long, either long")


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: pairs of members with different labels that share an element of their prefixes.

    members: id, fa, label, n_shingles. Elements are ordered by how many members hold them; a set's
    prefix is so long that what lies behind it is too little for a similarity of `percent`; two sets
    that are similar also hold enough behind the first element they share.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column("set")]
            which = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.record_batch([batch.column("id").take(which), batch.column("fa").take(which), pa.array(np.concatenate(sets))], names=["id", "fa", "e"])
        release_memory()

    held = sets.join(members.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(elements, "id long, fa long, e long")
    often = scratch.save(held.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = held.join(often, "e").groupBy("id", "fa").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("s"))
    # elements of this set alone come first in the order
    n = F.col("n_shingles").cast("int")
    alone = n - F.size("s")
    room = n - F.ceil(n * percent / 100 - 1e-9).cast("int") + 1 - alone
    prefix = shared.join(members, ["id", "fa"]).where(room > 0).select("id", "label", "n_shingles", (alone + 1).alias("next"), F.posexplode(F.slice("s", F.lit(1), room)).alias("k", "x"))
    prefix = scratch.save(prefix.select("id", "label", "n_shingles", (F.col("next") + F.col("k")).alias("at"), F.col("x.e").alias("e")), "prefix")
    sizes = prefix.groupBy("e", "label").agg(F.count("*").alias("n"))
    major = sizes.groupBy("e").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1").select("e", F.col("top.label").alias("major"))
    met = scratch.save(prefix.join(scratch.save(major, "major"), "e"), "met")
    one = scratch.save(met.where(F.col("label") != F.col("major")).select("e", F.col("id").alias("i"), F.col("label").alias("l"), F.col("n_shingles").alias("m"), F.col("at").alias("j")), "one")
    # behind the first element that two sets share, both must still hold enough
    enough = (100 + percent) * (F.least(F.col("n_shingles") - F.col("at"), F.col("m") - F.col("j")) + 1) >= percent * (F.col("n_shingles") + F.col("m"))
    both = met.join(one, "e").where((F.col("label") != F.col("l")) & ((F.col("label") == F.col("major")) | (F.col("id") < F.col("i"))) & enough)
    return both.select(F.greatest("id", "i").alias("a"), F.least("id", "i").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = 5, bands: int = 32, rows: int = 4, scratch: Scratch | None = None, log=None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    scratch = scratch or Scratch(docs.sparkSession, "near-dup")
    similar = 100 * F.col("common") >= percent * F.col("either")

    sign = scratch.save(signed(docs, shingle, bands, rows), "signed")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = sign.where(real).groupBy("fa", "fb").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    copies = scratch.save(classes.where("n > 1").select("fa", "fb", "least"), "copies")
    # a null doc_id has a null class
    member = sign.select("doc_id", "n_shingles", "fa", "fb").join(copies, ["fa", "fb"], "left")
    member = scratch.save(member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("class")), "member")
    # rows that share a doc_id link their classes
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    own = scratch.save(member.join(several, "doc_id").where("class != low").select(F.col("class").alias("a"), F.col("low").alias("b")).distinct(), "own")

    # rows of a class other than the one that stands for it have no bands of their own
    first = sign.where(real).join(copies, ["fa", "fb"], "left").where(F.col("least").isNull() | (F.col("least") == F.col("doc_id")))
    banded = first.select("doc_id", "n_shingles", "fa", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band", "n")
    buckets = scratch.save(banded.join(scratch.save(shared, "shared"), "band").select("band", F.col("doc_id").alias("id"), "n_shingles", "fa", "n").distinct(), "buckets")

    ids = scratch.save(buckets.groupBy("id").agg(F.sum("n").alias("met")), "ids")
    centre = buckets.join(ids, "id").groupBy("band").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"), "n_shingles")).alias("c"))
    centre = scratch.save(centre.select("band", (-F.col("c.minus")).alias("b"), F.col("c.n_shingles").alias("m")), "centre")
    near = (F.col("id") != F.col("b")) & (100 * F.least("n_shingles", "m") >= percent * F.greatest("n_shingles", "m"))
    pairs = buckets.join(centre, "band").where(near).select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = ids.select(F.col("id").alias("doc_id"))
    sets = scratch.save(sets_of(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), shingle), "sets", compression="none")
    seen = scratch.save(compared(scratch.save(pairs, "pairs0"), sets), "compared0")
    links = seen.where(similar).select("a", "b").unionByName(own)
    labels = components(links, scratch, "labels0")

    now = scratch.save(buckets.select("band", "id", "n_shingles", "fa").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")), "now")
    split = scratch.save(now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band"), "split")
    open_members = scratch.save(now.join(split, "band").select("id", "fa", "label", "n_shingles").distinct(), "open")
    rest = rare_pairs(open_members, sets, percent, scratch).join(seen.select("a", "b"), ["a", "b"], "left_anti")
    more = scratch.save(compared(scratch.save(rest, "pairs1"), sets), "compared1")
    if log:
        log("pairs", seen.count(), "links", links.count(), "open", open_members.count(), "rest", more.count(), "links", more.where(similar).count())
    links = more.where(similar).select("a", "b").unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
    labels = components(links, scratch, "labels1")
    out = member.join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
    out = out.withColumn("component_id", F.coalesce("label", "class"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
