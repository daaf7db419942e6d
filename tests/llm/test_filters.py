import hashlib
import random

import duckdb
import numpy as np
import pytest
from cases import SCHEMA, awkward, prose, table
from pyspark.sql import functions as F

from tessel.llm.decontam import FMIndex, find_contamination, words_of
from tessel.llm.oracle import DECONTAMINATION, QUALITY
from tessel.llm.quality import COUNTS, beta_prior, host_of, quality_rules


def sql(query, documents, benchmark=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    for name, rows in (("documents", documents), ("benchmark", benchmark)):
        for row in rows:
            con.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * len(row))})", [x.replace("\x00", "\x01") if isinstance(x, str) else x for x in row])
    return sorted(map(tuple, con.execute(query).fetchall()), key=str)


def crowd():
    rows = [(d, t and t.replace("\x00", "\x01"), a, b, c) for d, t, a, b, c in awkward()]
    rng = random.Random(1)
    for k in range(90):  # three hosts: a sound one, a bad one, a small one
        text = prose(k, rng.randrange(25, 60))
        if k % 3 == 1 and k % 9:
            text += " ###" * 30 if k % 2 else ("\n" + text) * 2
        rows.append((5000 + k, text, "en", ["good", "http://Bad.example/x?y", "c"][k % 3], 1))
    return rows


def test_quality_matches_sql(spark):
    rows = crowd()
    got = quality_rules(table(spark, rows, True).repartition(3), "doc_id").select("row.doc_id", *COUNTS, "base_failed", "kept", "host_strict").collect()
    assert sorted(map(tuple, got), key=str) == sql(QUALITY, rows)
    strict = {r.doc_id for r in got if r.host_strict}
    assert any(5000 <= d for d in strict)
    assert all(r.kept or r.base_failed or r.host_strict for r in got)


def test_quality_beyond_the_broadcast(spark):
    docs = table(spark, crowd())
    few, many = (sorted(map(tuple, quality_rules(docs, "doc_id", most_hosts=n).select("row.doc_id", "host", "failed", "host_strict", "kept").collect()), key=str) for n in (20_000, 0))
    assert few == many


def test_quality_of_null_and_repeated_ids(spark):
    good, bad = prose(3, 40), "too short"
    rows = [(None, good, "en", None, 1), (None, bad, "en", None, 1), (5, good, "en", "h", 1), (5, bad, "en", "h", 1), (5, bad, "en", "h", 1)]
    got = quality_rules(table(spark, rows), "doc_id").select("row.doc_id", "host", "n_words", "base_failed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "", 40, False), (None, "", 2, True), (5, "h", 40, False), (5, "h", 2, True), (5, "h", 2, True)], key=str)


def brute_repeats(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    seen, hit = {}, set()
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            hit.update(k + j for k in places for j in range(8))
    return len(words), len(hit)


def test_repeated_windows_by_hand(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))), None, None, None) for k in range(60)]
    rows += [(100 + k, (prose(k, 12) + "\n") * (k % 3 + 1) + prose(k + 9, 30), None, None, None) for k in range(20)]
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules(table(spark, rows), "doc_id").select("row.doc_id", *COUNTS).collect()}
    assert got == {d: brute_repeats(t) for d, t, *_ in rows}


def test_prior_shrinks_towards_the_mean():
    alpha, beta = beta_prior(0.2, 0.01, 0.02)
    assert alpha / (alpha + beta) == pytest.approx(0.2)
    assert beta_prior(0.2, 0.0, 0.02)[0] == pytest.approx(2000)
    assert beta_prior(0.0, 0.0, 1.0)[0] == 0


def test_hosts(spark):
    df = spark.createDataFrame([("https://A.b:80/c",), ("src1",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(host_of(F.col("s"))).collect()] == ["a.b:80", "src1", "", ""]


def test_quality_of_an_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def bench():
    items = [(k, prose(2000 + k, 8 + 4 * k)) for k in range(9)]
    return [*items, (3, items[3][1]), (20, None), (21, "  ."), (22, "tiny item"), (None, prose(2100, 20)), (24, items[5][1] + " and more")]


def polluted():
    rng, rows = random.Random(8), crowd()[:30]
    items = [t for _, t in bench() if t and len(t) > 20]
    for k in range(60):
        words = prose(k + 600, rng.randrange(5, 200)).split(" ")
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(items).split(" ")
            a = rng.randrange(len(part))
            at = rng.randrange(len(words))
            words[at:at] = part[a : a + rng.randrange(1, 40)]
        if k % 7 == 0:
            words.append("Tiny, ITEM")
        rows.append((7000 + k, " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 1 << 19), (300, 40)])
def test_contamination_matches_sql(spark, block_bytes, shard_words):
    rows, items = polluted(), bench()
    found = find_contamination(table(spark, rows, True).repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, shard_words=shard_words).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r.items), hashlib.sha256(",".join(r.items).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found]
    assert sorted(got, key=str) == sql(DECONTAMINATION, rows, items)
    texts = {d: t for d, t, *_ in rows}
    for r in found:  # offsets cut exactly the words of the spans
        assert [w for a in r.offsets for w in words_of(texts[r.doc_id][a.start : a.end].encode())] == [w for s in r.spans for w in words_of((texts[r.doc_id] or "").encode())[s.start : s.end]]


def test_contamination_of_unhappy_tables(spark):
    items = spark.createDataFrame(bench(), "item_id long, text string")
    assert find_contamination(spark.createDataFrame([], SCHEMA), items).count() == 0
    got = find_contamination(table(spark, awkward()), items.limit(0)).collect()
    assert len(got) == len(awkward())
    assert not any(r.n_hit for r in got)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    for _ in range(40):
        text = rng.integers(0, 4, rng.integers(2, 120))
        text[-1] = 0
        if not text.any():
            continue
        index = FMIndex(text, sample=4)
        phrases = rng.integers(1, 5, (30, 6))
        lengths = rng.integers(1, 7, 30)
        low, high = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
