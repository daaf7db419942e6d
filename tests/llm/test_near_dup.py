import random
from itertools import combinations

import numpy as np
from cases import SCHEMA, awkward, prose, table

from tessel.llm.common import Scratch
from tessel.llm.components import components
from tessel.llm.near_dup import near_duplicates
from tessel.llm.superminhash import signatures


def words(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Shingles and component of each row; rows that share a doc_id are one node."""
    sets, parent = [(doc_id, shingles(text)) for doc_id, text, *_ in rows], {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if a != b and s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets}


def edited(text, rng, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng, rows = random.Random(3), awkward()
    for family in range(12):  # similarities on both sides of the threshold
        base = prose(1000 + family, 60 + 40 * family)
        for k in range(14):
            rows.append((100 + 20 * family + k, edited(base, rng, rng.randrange(0, 3 + 2 * family)), "en", "s", 1))
    chain = prose(77, 200).split(" ")
    for k in range(12):  # each like the next, the ends unlike
        rows.append((500 + k, " ".join(chain[k * 8 : k * 8 + 110]), "en", "s", 1))
    rng.shuffle(rows)
    return rows


def test_classes_are_those_of_all_pairs(spark):
    rows, want = corpus(), brute(corpus())
    got = near_duplicates(table(spark, rows, True).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert len(got) == len(rows)


def test_unhappy_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    base = prose(1, 60)
    rows = [(1, base, None, None, None), (1, base, None, None, None), (None, base, None, None, None), (2, base + " x", None, None, None), (3, base + " x", None, None, None)]
    got = sorted(near_duplicates(table(spark, rows)).collect(), key=str)
    assert [(r.doc_id, r.component_id) for r in got if r.doc_id] == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_texts_of_one_doc_id_link_what_they_are_like(spark):
    a, b, c, d = (prose(300 + k, 80) for k in range(4))
    rows = [(3, a), (7, a), (7, b), (9, b + " end"), (9, c), (5, c + " end"), (8, d), (8, prose(311, 120)), (20, prose(311, 120) + " x"), (21, prose(400, 70))]
    rows = [(*r, "en", "s", 1) for r in rows] + [r for r in corpus() if r[0] >= 100]
    want = brute(rows)
    assert {d: want[d][1] for d in (3, 5, 7, 9, 8, 20, 21)} == {3: 3, 5: 3, 7: 3, 9: 3, 8: 8, 20: 8, 21: 21}
    got = near_duplicates(table(spark, rows, True).repartition(5)).collect()
    assert len(got) == len(rows)
    assert all((r.component_id, r.kept) == want[r.doc_id][1:] for r in got)


def test_one_signature_whatever_the_batch():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (150_000, 120_000, 3, 90_000, 260_000, 1)]
    got = signatures(np.concatenate(sets), np.array([len(x) for x in sets]), 8)
    assert (got == np.concatenate([signatures(x, np.array([len(x)]), 8) for x in sets])).all()


def slow_signature(elements, registers):
    """The register values by their definition, one element at a time."""
    from tessel.llm.superminhash import GOLDEN, mix

    out = [2**32 - 1] * registers
    for x in elements:
        order = list(range(registers))
        for step in range(registers):
            u = int(mix(np.array([(int(x) + (step + 1) * int(GOLDEN)) % 2**64], dtype=np.uint64))[0])
            k = step + ((u & 0xFFFFFFFF) * (registers - step) >> 32)
            order[step], order[k] = order[k], order[step]
            out[order[step]] = min(out[order[step]], step << 24 | u >> 40)
    return out


def test_signatures_stop_early_without_change():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (0, 1, 2, 5, 40, 300)]
    got = signatures(np.concatenate(sets), np.array([len(x) for x in sets]), 16)
    assert [x.tolist() for x in got] == [slow_signature(x, 16) for x in sets]


def test_registers_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    share = []
    for _ in range(40):
        x = rng.integers(0, 2**64, 500, dtype=np.uint64)
        a, b = signatures(np.concatenate([x[:400], x[100:]]), np.array([400, 400]), 128)
        share.append((a == b).mean())
    assert abs(np.mean(share) - 0.6) < 0.02


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(200, 201), (201, 202), (202, 200)]
    df = spark.createDataFrame(links, "a long, b long").repartition(9)
    got = {r.node: r.label for r in components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 180)}, 201: 200, 202: 200}
