import random
import time

import numpy as np
import pytest
from cases import SCHEMA, awkward, table

from tessel.llm.toxicity import CLASSES, Decoder, Scorer, classes_of, language_model, lattice, toxicity, trigram_counts

BAD = "idiot loser stupid pathetic worthless".split()
GOOD = "meadow river garden window paper stone water winter candle forest".split()


def corpus(n=600, seed=2):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(15, 40))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for _, text, *_ in corpus()[0]:
        c = classes_of(f"  {text}  ")
        np.add.at(total, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)
    return language_model(total)


@pytest.mark.parametrize("text", ["1d10t", "an 1d!ot!", "s t u p i d", "l-o-s-e-r", "stuuuupid", "$tup1d.", "p4thetic", "w0rthle$$", "L0SER", "iiidiooot", "l.o.s.e.r and"])
def test_disguised_words_are_restored(model, text):
    assert set(BAD) & Decoder(model).words(text)


@pytest.mark.parametrize(
    "text",
    ["1 d 1 0 t", "s t u p 1 d", "i d i 0 t", "i/d/i/o/t", "i  d  i  o  t", "i\u00a0d\u00a0i\u00a0o\u00a0t", "i - d - i - o - t", "i.d-i_o*t", "st-up-id", "stu.pid", "lo_ser", "st-up-1d.", "iiddiioott", "ssttuuppiidd", "iddiot", "l0sser", "s.t.u.p.1.d", "stup111d", "1d1000t", "lo$$$er"],
)
def test_mixed_disguises_are_restored(model, text):
    assert set(BAD) & Decoder(model).words(text)
    weights = dict.fromkeys(BAD, 1.0)
    assert set(BAD) & Scorer(model, weights, 0.0).features(f"meadow {text} river")


@pytest.mark.parametrize(("unit", "spaced"), [("1 d 1 0 t", True), ("st--up-1d", True), ("iiddot", False)])
def test_viterbi_finds_the_best_path_of_mixed_disguises(model, unit, spaced):
    assert Decoder(model).decode(unit, spaced) == best_path(model, unit, spaced)


def test_plain_words_stay(model):
    assert Decoder(model).words("Meadow rivers, 3 windows\nand a1 papers I a b") >= {"meadow", "rivers", "windows", "papers"}
    assert not set(BAD) & Decoder(model).words("river 1000 22 f00 a b c wateeer")


def best_path(model, unit, spaced):
    """The best path by trying all of them."""
    edges, best = lattice(unit, spaced), (-np.inf, "")
    stack = [(0, (0, 0), 0.0, "")]
    while stack:
        k, (a, b), score, out = stack.pop()
        if k == len(unit):
            best = max(best, (score + float(model[a, b, 0]), out))
            continue
        for end, written, cost in edges[k]:
            x, y, total = a, b, score + cost
            for ch in written:
                c = int(classes_of(ch)[0])
                total += float(model[x, y, c])
                x, y = y, c
            stack.append((end, (x, y), total, out + written))
    return best[1]


@pytest.mark.parametrize(("unit", "spaced"), [("1d10t", False), ("s1lly", False), ("wwww4t", False), ("l 0 s e r", True), ("a1!|0", False), ("a$$$le", False), ("t00011", True)])
def test_viterbi_finds_the_best_path(model, unit, spaced):
    assert Decoder(model).decode(unit, spaced) == best_path(model, unit, spaced)


def test_trigrams_are_counted_over_all_texts(spark):
    rows = awkward()
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for _, text, *_ in rows:
        c = classes_of(f"  {text or ''}  ")
        np.add.at(total, (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], 1)
    got = trigram_counts(table(spark, rows, True).repartition(3))
    total[0] = got[0] = 0  # spaces between texts
    assert (got == total).all()


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(9000 + k, f"the {GOOD[k]} is for an {x} of {GOOD[-k]}", None, None, None) for k, x in enumerate(["1d10t", "s t u p i d", "loooser"])]
    got = {r.doc_id: r for r in toxicity(table(spark, rows, True), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[d].predicted, y) for d, y in labels if got[d].held_out]
    assert len(held) > 150
    assert sum(p == y for p, y in held) / len(held) > 0.98
    assert all(got[9000 + k].predicted for k in range(3))
    assert len(got) == len(rows)


def test_disguises_in_long_texts_without_spaces(model):
    """Time in proportion to the text, and what is hidden in it is found."""
    rng = random.Random(1)
    scorer = Scorer(model, dict.fromkeys(BAD, 1.0), 0.0)
    base = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for text in ("," * 1_000_000, "a,b1" * 100_000, base("\u4e2d\u6587\u5b57\u7b26", 1_000_000), "ab" * 300_000, "a," * 200_000, "zz" * 100_000):
        began = time.process_time()
        scorer.features(text)
        assert time.process_time() - began < 60
    for hidden in ("1d10t", "stup1d"):
        assert scorer.features(base(",;:", 5000) + hidden + base(",;:", 5000))
    letters = ", ".join("bcdfg"[k % 5] for k in range(4000))
    assert scorer.features(f"{letters}\nsuch a garden s t u p i d garden {letters}")


def test_combined_disguises_through_the_query(spark):
    rows, labels = corpus()
    hidden = ["1 d 1 0 t", "s.t.u.p.1.d", "l-0-s-e-r", "ssttuuppiidd", "stup111d", "p4thet1c"]
    rows += [(9000 + k, f"the {GOOD[k]} is for an {x} of {GOOD[-k]}", None, None, None) for k, x in enumerate(hidden)]
    rows += [(9100 + k, "," * 50_000 + GOOD[k], None, None, None) for k in range(2)]
    got = {r.doc_id: r.predicted for r in toxicity(table(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[9000 + k] for k in range(len(hidden))] == [1] * len(hidden)
    assert [got[9100], got[9101]] == [0, 0]


def test_unhappy_tables(spark):
    labels = spark.createDataFrame([(10, 1), (10, 0), (11, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(table(spark, awkward(), True), labels).collect()
    assert len(got) == len(awkward())
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert toxicity(table(spark, awkward()), spark.createDataFrame([], "doc_id long, toxic int")).count() == len(awkward())
