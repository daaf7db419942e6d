import pytest
from cases import SCHEMA, prose, table
from test_dedup import brute_gone
from test_filters import bench, brute_repeats, polluted
from test_near_dup import brute, corpus
from test_tokens import check_packed

import corpus_pipeline
from tessel.llm.decontam import words_of


def lose_lines(rows):
    gone = brute_gone(rows, 2, 10, corpus_pipeline.ALONE_WORDS)
    out = []
    for doc_id, text, *rest in rows:
        if doc_id in gone:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[doc_id])
            if not text.strip(" \t\n\x0b\x0c\r"):
                continue
        out.append((doc_id, text, *rest))
    return out


def contaminated(text, items):
    words, hit = words_of((text or "").encode()), set()
    for _, item in items:
        w = words_of((item or "").encode())
        for a in range(max(1, len(w) - 12) if w else 0):
            phrase = w[a : a + 13]
            for k in range(len(words) - len(phrase) + 1):
                if words[k : k + len(phrase)] == phrase:
                    hit.update(range(k, k + len(phrase)))
    return bool(hit) and 20 * len(hit) >= len(words)


def rows_in():
    rows = [r for r in polluted() if r[0] >= 5000 and r[0] != 18]
    rows += [(8000, "too short", "en", "s", 1), (8001, dict(bench())[7], "en", "s", 1)]
    one_line = prose(4242, 120).replace("\n", " ")
    rows += [(8100 + k, f"{one_line} and {k}", "en", "s", 1) for k in range(5)]
    return rows + [r for r in corpus() if 100 <= r[0]]


def base_ok(text):
    n, repeated = brute_repeats(text or "")
    return n >= 20 and 100 * repeated <= 30 * n


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows in and out of each stage, as the run makes them."""
    folder = tmp_path_factory.mktemp("data")
    table(spark, rows_in()).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench(), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, columns, docs.columns, before, docs.collect()))
    return str(folder), out


def test_stages_keep_the_columns(stages):
    for name, before, after, *_ in stages[1][:-1]:
        assert before == after, name
    assert [x[0] for x in stages[1]] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


def test_each_stage_decides_as_brute_force(stages):
    quality, lines, near, clean, packed = (x[3:] for x in stages[1])
    kept = {r[0] for r in quality[1]}
    assert kept <= {r[0] for r in quality[0] if base_ok(r[1])}
    assert sorted(map(tuple, lines[1])) == sorted(lose_lines(lines[0]))
    want = brute(near[0])
    assert sorted(map(tuple, near[1])) == sorted(r for r in near[0] if want[r[0]][2])
    assert sorted(map(tuple, clean[1])) == sorted(r for r in clean[0] if not contaminated(r[1], bench()))
    check_packed(packed[1], packed[0], 4096)
    assert [len(after) < len(before) for before, after in (quality, near, clean)] == [True] * 3


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    got = corpus_pipeline.run(spark, stages[0]).collect()
    docs = {r.doc_id for r in got}
    assert docs == {r.doc_id for r in stages[1][-1][4]}
    assert sum(r.length for r in got) == sum(r.length for r in stages[1][-1][4])
    assert len(set(map(key, got))) == len(got)


def test_stages_treat_rows_of_null_and_repeated_ids_each(spark, tmp_path):
    spark.createDataFrame(bench(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = (prose(1500 + k, 70) for k in range(3))
    bad = dict(bench())[7]
    rows = [(3, a), (7, a), (7, b), (9, b + " end"), (None, c), (None, c), (None, c + " x"), (4, c), (5, bad), (5, c + " and quite another end of it all"), (None, bad), (6, None), (6, None), (None, "")]
    rows = [(*r, "en", "s", 1) for r in rows]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    docs = table(spark, rows).repartition(3)
    near = [(3, a), (7, b), (4, c), (5, bad), (6, None), (None, "")]
    assert pairs(corpus_pipeline.near_dup_stage(spark, docs, str(tmp_path))) == sorted(near, key=str)
    clean = [r[:2] for r in rows if r[1] != bad]
    assert pairs(corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))) == sorted(clean, key=str)
    line = " ".join(f"w{k}" for k in range(30))
    docs = table(spark, [(8, f"{line}\nown", "en", "s", 1), (8, f"{line}\nother", "en", "s", 1), (None, line, "en", "s", 1)])
    assert [x[1] for x in pairs(corpus_pipeline.line_stage(spark, docs, str(tmp_path)))].count(line) == 0
    docs = table(spark, [(None, a, "en", None, 1), (8, a, "en", None, 1), (8, a, "en", None, 1), (None, None, None, None, None)])
    assert pairs(corpus_pipeline.quality_stage(spark, docs, str(tmp_path))) == sorted([(None, a), (8, a), (8, a)], key=str)
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length) for r in packed if r.doc_id is None)[-1][1] > 60
    assert sum(r.doc_tokens == 1 for r in packed) == 1


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench(), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
