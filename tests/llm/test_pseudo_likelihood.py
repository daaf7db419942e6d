import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import SCHEMA, awkward, table

from tessel.llm.common import Scratch
from tessel.llm.pseudo_likelihood import BEHIND, CLASS_OF, LENGTHS, RARE, SPELLING, Entries, Network, Shape, assign_classes, fit, score_documents, spelling_codes, spelt, windows_of, word_counts, words_of

SHAPE = Shape(classes=12, groups=3, contexts=4)
FOLDED = lambda text: (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def slow_window(c, k, shape):
    at = lambda j: int(c[j]) if 0 <= j < len(c) else 0
    group = lambda x: 0 if x == 0 else 1 + (x - 1) * (shape.groups - 1) // (shape.classes - 1)
    return ((group(at(k - 2)) * shape.classes + at(k - 1)) * shape.classes + at(k + 1)) * shape.groups + group(at(k + 2))


def test_windows_stay_inside_their_text():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 12, n) for n in (3, 0, 1, 7, 2)]
    got = windows_of(np.concatenate(texts), np.array([len(x) for x in texts]), SHAPE)
    assert got.tolist() == [slow_window(x, k, SHAPE) for x in texts for k in range(len(x))]
    assert got.max() < SHAPE.windows


def test_gradients_lower_the_loss_to_that_of_the_counts():
    rng = np.random.default_rng(1)
    counts = np.zeros((SHAPE.windows, SHAPE.classes))
    rows = rng.choice(SHAPE.windows, 60, replace=False)
    counts[rows, 1 + rng.integers(0, 11, 60)] = rng.integers(1, 50, 60)
    network = Network(SHAPE, hidden=24)
    losses = network.train(counts, rounds=300)
    assert losses[-1] < 0.3 * losses[0]
    p = np.exp(network.forward(np.arange(SHAPE.windows))[1])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert (p[:, 0] == 0).all()


def test_classes_hold_all_entries():
    counts = np.zeros(1000, dtype=np.int64)
    counts[:100] = np.arange(100)[::-1] ** 3
    classes = assign_classes(counts, SHAPE)
    assert classes.min() >= 1
    assert classes.max() == SHAPE.classes - 1
    assert len(set(classes[:100].tolist())) == SHAPE.classes - 1


def corpus():
    rng, rows = random.Random(4), []
    nouns, verbs = "cat dog bird fish".split(), "sees likes hears".split()
    for k in range(300):
        text = " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)} ." for _ in range(8))
        rows.append((1000 + k, text, "en", "s", 1))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark, corpus()), SHAPE)[0]


def of_length(word):
    return sum(len(word) >= x for x in LENGTHS)


def test_counts_cover_all_documents(spark):
    rows = corpus() + awkward()
    words = Counter(w for r in rows for w in FOLDED(r[1]))
    want = {(of_length(w), int(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64))): n for w, n in words.items()}
    for held in (1_000_000, 20):
        got = {(r.kind, r.key): r.n for r in word_counts(table(spark, rows, True).repartition(5), Scratch(spark, "t"), held).collect()}
        assert {k: n for k, n in got.items() if k[0] != SPELLING} == want
        spelt = Counter()
        for w, n in words.items():
            b = b"  " + w + b" "
            for k in range(2, len(b)):
                spelt[(SPELLING, int((CLASS_OF[b[k - 2]] * BEHIND + CLASS_OF[b[k - 1]]) * 256 + b[k]))] += n
        assert {k: n for k, n in got.items() if k[0] == SPELLING} == spelt


def slow_model(rows, share):
    """Vocabulary, entries and their counts by context, counted plainly."""
    words = [FOLDED(r[1]) for r in rows]
    counts = Counter(w for x in words for w in x)
    least = max(2, share * sum(counts.values()))
    return words, {w for w, n in counts.items() if n >= least}


@pytest.mark.parametrize("share", [1e-9, 0.004])
def test_scores_are_sums_of_conditionals(spark, share):
    rows = corpus() + awkward()
    got = {r.doc_id: r for r in score_documents(table(spark, rows, True).repartition(3), SHAPE, rounds=5, least_share=share).collect()}
    fitted = fit(table(spark, rows), SHAPE, rounds=5, least_share=share)[0]
    texts, frequent = slow_model(rows, share)
    assert len(fitted.vocabulary) == len(frequent)
    place = {int(h): k for k, h in enumerate(fitted.vocabulary)}
    entry = lambda w: place[xxhash.xxh64_intdigest(w)] if w in frequent else len(frequent) + of_length(w)
    # how often each entry stands in each context, and what that makes its share of the class
    found, total = Counter(), Counter()
    for text in texts:
        c = [int(fitted.classes[entry(w)]) for w in text]
        for k, w in enumerate(text):
            z = int(fitted.contexts[slow_window(c, k, SHAPE)])
            found[entry(w), z] += 1
            total[c[k], z] += 1
    n = Counter(entry(w) for x in texts for w in x)
    mass = Counter()
    for e in range(len(frequent) + RARE):
        mass[int(fitted.classes[e])] += n[e] + 1
    for (doc_id, *_), text in list(zip(rows, texts, strict=True))[-40:]:
        c, want = [int(fitted.classes[entry(w)]) for w in text], 0.0
        for k, w in enumerate(text):
            window = slow_window(c, k, SHAPE)
            z, e = int(fitted.contexts[window]), entry(w)
            want += float(fitted.table[window, c[k]]) + np.log((found[e, z] + 10 * (n[e] + 1) / mass[c[k]]) / (total[c[k], z] + 10))
            if w not in frequent:
                want += sum(float(fitted.spelling[x]) for x in spelling_codes([w]))
        assert got[doc_id].n_words == len(text)
        assert got[doc_id].log_prob == pytest.approx(want, rel=1e-4, abs=1e-3)
        assert (got[doc_id].score is None) == (len(text) == 0)


def test_probabilities_of_all_words_sum_to_one(model):
    """Of the entries, given any window; a rare entry's is shared out by spelling."""
    rng = np.random.default_rng(3)
    for window in rng.integers(0, SHAPE.windows, 20):
        p = np.exp(model.table[window, model.classes].astype(float) + model.shares[:, model.contexts[window]])
        used = np.exp(model.table[window])[sorted(set(model.classes.tolist()))].sum()
        assert p.sum() == pytest.approx(used, abs=1e-3)
    three = np.exp(model.spelling.reshape(BEHIND, BEHIND, 256).astype(float))
    assert np.allclose(three.sum(axis=2), 1, atol=1e-3)


def log_prob(model, text):
    words, counts = words_of([text.encode()])
    entry = Entries(model.vocabulary).of(words)
    return model.log_probs(entry, counts).sum() + spelt([w for w, k in zip(words, entry, strict=True) if k >= len(model.vocabulary)], model.spelling).sum()


def test_text_scores_above_its_words_in_disorder(model):
    better = 0
    for _, text, *_ in corpus()[:60]:
        words = text.split()
        random.Random(1).shuffle(words)
        better += log_prob(model, text) > log_prob(model, " ".join(words))
    assert better == 60


def test_words_of_one_class_are_told_apart_by_their_windows(spark):
    """Two words of equal count that stand in different windows: each is likelier in its own."""
    rng, rows = random.Random(6), []
    for k in range(200):
        own = ["x%d" % rng.randrange(40) for _ in range(10)]
        text = " ".join(f"left{k % 2} {'apple' if k % 2 else 'stone'} right{k % 2} {w}" for w in own)
        rows.append((k, text, "en", "s", 1))
    fitted = fit(table(spark, rows), Shape(classes=4, groups=3, contexts=6))[0]
    for k, (mine, other) in enumerate((("stone", "apple"), ("apple", "stone"))):
        here = lambda w: log_prob(fitted, f"x1 left{k} {w} right{k} x2")  # noqa: B023, E731
        assert here(mine) > here(other) + 0.5


def test_an_empty_table(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA), SHAPE, rounds=2).count() == 0
