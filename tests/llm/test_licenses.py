import numpy as np
import pytest
from cases import SCHEMA, awkward, prose, table

from tessel.llm.decontam import words_of
from tessel.llm.licenses import TEMPLATES, Scanner, band_keys, bands_for, least_similarity, minhashes, scan_licenses


def shingles(text):
    w = words_of(text.encode())
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def brute(rows, templates):
    """(doc_id, license) where some stretch of the template's length holds three quarters of its shingles."""
    out = set()
    for doc_id, text, *_ in rows:
        s = shingles(text or "")
        for name, t in templates.items():
            want = set(shingles(t))
            for a in range(max(1, len(s) - len(want) + 1)):
                if 100 * len(want & set(s[a : a + len(want)])) // len(want) >= 75:
                    out.add((doc_id, name))
                    break
    return out


def gridded(rows, templates):
    """(doc_id, license) where one of the windows of the template's group holds three quarters of it: every window compared, without bands."""
    sets = {name: set(shingles(t)) for name, t in templates.items()}
    longest = {}
    for x in sets.values():
        longest[len(x).bit_length()] = max(longest.get(len(x).bit_length(), 0), len(x))
    out = set()
    for doc_id, text, *_ in rows:
        s = shingles(text or "")
        for name, want in sets.items():
            most = longest[len(want).bit_length()]
            starts = range(0, max(1, len(s)), max(1, most // 2))
            if any(100 * len(want & set(s[a : a + most + most // 2])) >= 75 * len(want) for a in starts):
                out.add((doc_id, name))
    return out


def corpus():
    rows = awkward()
    for k, (_, text) in enumerate(TEMPLATES.items()):
        words = text.split()
        rows.append((300 + k, f"{prose(k, 30)} {text} {prose(k + 50, 700)}", "en", "s", 1))
        rows.append((400 + k, text.upper().replace(" ", "\n"), "en", "s", 1))
        edited = " ".join("zzz" if j % 60 == 30 else w for j, w in enumerate(words))
        rows.append((500 + k, prose(k, 17) + " " + edited, "en", "s", 1))
        rows.append((600 + k, prose(k, 11) + " " + " ".join(words[: len(words) // 2]) + " " + prose(3, 20), "en", "s", 1))
    return rows


def test_matches_are_those_of_every_window(spark):
    rows = corpus()
    got = scan_licenses(table(spark, rows, True).repartition(3)).collect()
    want = brute(rows, TEMPLATES)
    assert want <= {(r.doc_id, r.license) for r in got}
    # a window is half as long again as a template, so a match may be spread a little wider
    assert {(r.doc_id, r.license) for r in got} == gridded(rows, TEMPLATES)
    assert all(r.percent >= 75 for r in got)
    assert {(r.doc_id, r.license) for r in got if r.doc_id < 300} == set()
    first = {(r.doc_id, r.license): r.first_word for r in got}
    assert all(abs(first[300 + k, name] - len(words_of(prose(k, 30).encode()))) <= 4 for k, name in enumerate(TEMPLATES))


@pytest.mark.parametrize("share", [0.75, 1.0])
def test_bands_meet_as_often_as_promised(share):
    rng, misses = np.random.default_rng(0), 0
    rows, miss = 2, 1e-2
    least = least_similarity(share, 40, 40)
    bands = bands_for(least, rows, miss)
    for _ in range(400):
        t = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64))
        own = t[: int(share * 40)]
        w = np.unique(np.concatenate([own, rng.integers(0, 2**64, 60 - len(own), dtype=np.uint64)]))
        assert len(np.intersect1d(t, w)) / len(np.union1d(t, w)) >= least - 1e-9
        a, b = (band_keys(minhashes(x, np.array([len(x)]), bands * rows), rows)[0] for x in (t, w))
        misses += not (a == b).any()
    assert misses <= 12


def test_unhappy_tables(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, TEMPLATES["MIT-notice"], None, None, None)] * 2
    assert [(r.doc_id, r.license, r.n_words) for r in scan_licenses(table(spark, rows)).collect()] == [(None, "MIT-notice", 5)] * 2
    assert Scanner({"none": " . "}).scan(b"a b c d e f") == []
    two = Scanner({"x": "only three words"})
    assert two.scan(b"only three words") == [("x", 0, 5, 100)]


@pytest.mark.parametrize("name", list(TEMPLATES))
@pytest.mark.parametrize("between", ["", "and then"])
def test_copies_in_a_row_are_matches_each(name, between):
    scanner, n = Scanner({name: TEMPLATES[name]}), len(words_of(TEMPLATES[name].encode()))
    got = scanner.scan(f" {between} ".join([TEMPLATES[name]] * 3).encode())
    step = n + len(between.split())
    assert got == [(name, k * step, n, 100) for k in range(3)]


def test_typographic_marks():
    scanner = Scanner({"x": 'the "License" is - as we say - not ours, it\'s theirs'})
    assert scanner.scan("the “License” is — as we say – not ours, it’s theirs".encode()) == scanner.scan(b'the "License" is - as we say - not ours, it\'s theirs')
    assert scanner.scan("«the» ‹License› is… as we say ‐ not ours‚ it‘s theirs".encode())[0][3] == 100
