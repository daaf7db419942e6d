import random
import re

import numpy as np
import pytest
import xxhash
from cases import SCHEMA, awkward, prose, table

from tessel.llm.line_runs import line_dedup, repeated_runs
from tessel.llm.unit_dedup import CHARACTERS, MARKS, UNITS, WINDOW, occurrences, pieces_of, repeated_spans


def longest_earlier(ids, rank):
    """For each place of the document of that rank: the longest run of lines that also begins earlier, and the earliest place where it does."""
    own, out = ids[rank], []
    for p in range(len(own)):
        best = (0, None, None)
        for d in range(rank + 1):
            for q in range(p if d == rank else len(ids[d])):
                n = 0
                while p + n < len(own) and q + n < len(ids[d]) and own[p + n] == ids[d][q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, q)
        n, d, q = best
        out.append((min(n, p - q) if d == rank else n, d))
    return out


def brute_runs(rows, least_lines, least_words, alone_words=None):
    """Runs to delete of each document: numbers of lines, words and first document, from the definition of a maximal repeated run."""
    docs = sorted({(d, text or "") for d, text, *_ in rows})
    lines = [[(k, x.strip()) for k, x in enumerate(text.encode().split(b"\n")) if x.strip()] for _, text in docs]
    ids, out = [[x for _, x in own] for own in lines], {}
    for rank, own in enumerate(lines):
        found = [(p, n, sum(len(x.split()) for _, x in own[p : p + n]), d) for p, (n, d) in enumerate(longest_earlier(ids, rank)) if n]
        found = [x for x in found if x[2] >= least_words and x[1] >= least_lines or alone_words is not None and x[1] < least_lines and x[2] >= alone_words]
        for p, n, words, d in found:
            if not any(q < p and p + n <= q + m for q, m, *_ in found):
                out.setdefault(docs[rank][0], []).append(([k for k, _ in own[p : p + n]], words, docs[d][0]))
    return out


def brute_gone(rows, *limits):
    return {d: {k for run, *_ in runs for k in run} for d, runs in brute_runs(rows, *limits).items()}


def lined(seed=5):
    rng, rows = random.Random(seed), awkward()
    pool = [f"line {k} of the common pool" for k in range(12)] + ["", "  ", "x"]
    for k in range(60):
        rows.append((1000 + k, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randrange(0, 25))), "en", "s", 1))
    rows += [(2000, "\n".join(["same same"] * 9), "en", "s", 1), (2001, "\n".join(["same same"] * 4), "en", "s", 1)]
    return rows


def runs_of(spark, rows, *limits, parts=4):
    got = {}
    for r in repeated_runs(table(spark, rows, True).repartition(parts), *limits[:2], alone_words=limits[2] if limits[2:] else None).collect():
        got.setdefault(r.doc, []).append((r.lines, r.n_words, r.first_doc))
    return {d: sorted(x) for d, x in got.items()}


@pytest.mark.parametrize("limits", [(1, 0), (2, 10), (3, 0), (5, 0), (2, 10, 10), (2, 12, 14)])
def test_runs_are_the_maximal_repeated_ones(spark, limits):
    rows = lined()
    assert runs_of(spark, rows, *limits) == brute_runs(rows, *limits)


def test_runs_of_all_lengths_share_a_beginning(spark):
    """Copies that part after 1, 2, 3, ... lines, so intervals of every depth lie in one another."""
    rng, rows = random.Random(8), []
    base = [f"line {k} of one text" for k in range(23)]
    for k in range(40):
        a = rng.randrange(0, 20)
        rows.append((100 + k, "\n".join([f"own {k}", *base[a : a + rng.randrange(1, 24)], f"end {k}", *(base[:5] if k % 7 == 0 else [])]), "en", "s", 1))
    for limits in ((1, 0), (2, 10), (4, 0)):
        assert runs_of(spark, rows, *limits) == brute_runs(rows, *limits)


def test_pairs_of_lines_are_not_joined_to_reach_the_limit(spark):
    a, b, c, d = (f"{x} has three" for x in "abcd")
    rows = [(1, f"{a}\n{b}\nfirst", "en", "s", 1), (2, f"{b}\n{c}\nsecond", "en", "s", 1), (3, f"{c}\n{d}\nthird", "en", "s", 1), (4, "\n".join([a, b, c, d]), "en", "s", 1)]
    assert runs_of(spark, rows, 2, 10) == {}
    assert {r.doc_id: r.text for r in line_dedup(table(spark, rows)).collect()} == {r[0]: r[1] for r in rows}
    rows.append((5, "\n".join([a, b, c, d, "more"]), "en", "s", 1))
    assert runs_of(spark, rows, 2, 10) == {5: [([0, 1, 2, 3], 12, 4)]}


@pytest.mark.parametrize("most_broadcast", [0, 10**6])
def test_line_dedup_keeps_columns_and_other_documents(spark, most_broadcast):
    rows = lined()
    want, kept = brute_gone(rows, 2, 10), {}
    df = table(spark, rows, True)
    out = line_dedup(df.repartition(3), most_broadcast=most_broadcast)
    assert out.columns == df.columns
    for r in out.collect():
        kept[r.doc_id] = r.text
    for doc_id, text, *_ in rows:
        gone = want.get(doc_id, set())
        left = text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert (doc_id not in kept) if gone and not left.strip() else kept[doc_id] == left


def test_a_long_line_is_a_run_by_itself(spark):
    long = " ".join(f"w{k}" for k in range(55))
    rows = [(1, f"own one\n{long}\nown two\nshort line", "en", "s", 1), (2, f"other one\n{long}\nother two\n\nshort line", "en", "s", 1), (3, long, "en", "s", 1), (4, f"{long}\nlast", "en", "s", 1)]
    assert runs_of(spark, rows, 2, 10, 10) == {d: [(x, 55, 1)] for d, x in ((2, [1]), (3, [0]), (4, [0]))}
    left = {r.doc_id: r.text for r in line_dedup(table(spark, rows), alone_words=10).collect()}
    assert left == {1: rows[0][1], 2: "other one\nother two\n\nshort line", 4: "last"}


def test_words_are_parted_by_any_ascii_white_space(spark):
    rows = [(1, "a\tb  c\x0bd\none two", "en", "s", 1), (2, "a\tb  c\x0bd\none two", "en", "s", 1)]
    assert runs_of(spark, rows, 2, 6) == {2: [([0, 1], 6, 1)]}
    assert runs_of(spark, rows, 2, 7) == {}


def test_runs_of_unhappy_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeated_runs(empty).count() == 0
    assert line_dedup(empty).count() == 0
    two = "a line of five words\nand another one of six words"
    rows = [(1, two, None, None, None), (1, two, None, None, None), (None, two, None, None, None)]
    got = sorted(line_dedup(table(spark, rows)).collect(), key=str)
    assert [(r.doc_id, r.text) for r in got] == [(1, two), (1, two)]


def slow_units(text):
    """Words with their offsets and weights, and the borders of units, in plain steps from the definition."""
    words = []
    for m in re.finditer(r"\S+", text):
        token = m.group()
        cuts = [0]
        if len(token) > CHARACTERS:
            cuts = pieces_of(np.array([ord(c) for c in token], dtype=np.uint32)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(token)], strict=True):
            low = token[a:b].lower()
            words.append((low.strip(MARKS) or low, m.start() + a, m.start() + b, 1 if len(token) <= CHARACTERS else max(1, (b - a) // 6), len(token) > CHARACTERS))
    least = [xxhash.xxh64_intdigest(w[0].encode()) for w in words]
    lines = [k for k in range(len(words)) if k == 0 or "\n" in text[words[k - 1][2] : words[k][1]]]
    borders = set(lines)
    borders.update(k for k in range(len(words)) if words[k][4] or k and words[k - 1][4])
    for k in range(len(words) - WINDOW + 1):
        if not any(w[4] for w in words[k : k + WINDOW]):
            borders.update(j for j in range(k, k + WINDOW) if least[j] == min(least[k : k + WINDOW]))
    return words, sorted(borders), lines


def slow_runs(text, least_words):
    words, borders, lines = slow_units(text)
    borders, lines = [*borders, len(words)], [*lines, len(words)]
    weight = lambda a, b: sum(w[3] for w in words[a:b])
    runs = {(a, b) for a, b in zip(lines, lines[1:], strict=False) if weight(a, b) >= least_words}
    n = len(borders) - 1
    for k in range(n):
        ends = [e for e in range(k + 1, n + 1) if weight(borders[k], borders[e]) >= least_words]
        if ends:
            runs.add((borders[k], borders[min(max(ends[0], k + UNITS), n)]))
        begins = [e for e in range(k + 1) if weight(borders[e], borders[k + 1]) >= least_words]
        if begins:
            runs.add((borders[max(min(begins[-1], k + 1 - UNITS), 0)], borders[k + 1]))
    return sorted((words[a][1], words[b - 1][2], tuple(w[0] for w in words[a:b])) for a, b in runs)


def brute_spans(rows, least_words=16):
    """Merged spans of each text, from a scan in rank order. Rows of one doc_id have to be alike here."""
    seen, out = set(), {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}):
        spans = []
        for start, end, words in slow_runs(text, least_words):
            if words in seen:
                spans.append((start, end))
            seen.add(words)
        merged = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        if merged:
            out[doc_id] = [tuple(x) for x in merged]
    return out


def spans_of(spark, rows, parts=5, **options):
    got = {}
    for r in repeated_spans(table(spark, rows, True).repartition(parts), **options).collect():
        got.setdefault((r.doc_id, r.copy) if r.copy else r.doc_id, []).append((r.start, r.end))
    return {d: sorted(x) for d, x in got.items()}


def repeated_line(k):
    return prose(3200 + k % 3, 21).replace("\n", " ")


def pasted():
    passage = "Mind the gap here. " + ". ".join(prose(900 + k, 9).capitalize() for k in range(6)) + ". So ends it."
    rows = [r for r in awkward() if r[0] != 18]
    for k in range(9):
        a, b = prose(3000 + k, 30), prose(4000 + k, 30)
        rows.append((700 + k, f"{a} {passage} {b}", "en", "s", 1))
        rows.append((800 + k, f"{prose(3100 + k, 13 + k)}\n{repeated_line(k)}\n{prose(4100 + k, 17)}", "en", "s", 1))
    rng = random.Random(4)
    rows += [(900 + k, " ".join(rng.choice(("aa", "Bb,", "c.", "\n", "dd")) for _ in range(60)), "en", "s", 1) for k in range(6)]
    return passage, rows


@pytest.mark.parametrize("options", [{}, {"flush_at": 50, "bucket_bytes": 500, "batch_chars": 300}])
def test_spans_are_those_of_a_scan_in_rank_order(spark, options):
    _, rows = pasted()
    want = brute_spans(rows)
    assert len(want) > 12
    assert spans_of(spark, rows, **options) == want


def test_pasted_passages_go_and_the_rest_stays(spark):
    passage, rows = pasted()
    got = spans_of(spark, rows)
    assert 700 not in got
    for doc_id, text, *_ in rows:
        if 700 < doc_id < 800:
            at = text.index(passage)
            (start, end), *more = got[doc_id]
            assert not more
            assert at <= start < at + 12 * 8
            assert at + len(passage) - 12 * 8 < end <= at + len(passage)
    assert not [d for d in got if 30 <= d < 40]
    # a repeated line goes whole, and no other
    texts = {r[0]: r[1] for r in rows}
    assert {d: [texts[d][a:b] for a, b in got[d]] for d in range(803, 809)} == {d: [repeated_line(d - 800)] for d in range(803, 809)}
    assert not {800, 801, 802} & set(got)


def covered(rows, passage, doc_id):
    text = next(r[1] for r in rows if r[0] == doc_id)
    at = text.index(passage)
    return sum(max(0, min(b, at + len(passage)) - max(a, at)) for a, b in brute_spans(rows).get(doc_id, ())) / len(passage)


def test_most_of_a_passage_without_breaks_goes_wherever_it_stands():
    plain = lambda seed, n: prose(seed, n).replace(".", "").replace("\n", " ")
    shares = []
    for k in range(40):
        passage = plain(5000 + k, 50)
        rows = [(x, f"{plain(6000 + 9 * k + x, 20 + x)} {passage} {plain(7000 + 9 * k + x, 25 - x)}", "en", "s", 1) for x in range(3)]
        assert 0 not in brute_spans(rows)
        shares += [covered(rows, passage, x) for x in (1, 2)]
    assert min(shares) > 0.4
    assert sum(shares) / len(shares) > 0.75


def test_most_of_a_passage_without_spaces_goes():
    rng = random.Random(3)
    script = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = script(300)
    rows = [(x, script(70 + x) + passage + script(60), "zh", "s", 1) for x in range(2)]
    assert covered(rows, passage, 1) > 0.5


def test_a_very_long_text_without_spaces():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef,") for _ in range(1_000_000))
    owner, a, _, start, end = occurrences([text, text[500_000:]], 16)
    assert set(a[owner == 1]) - set(a[owner == 0]) != set(a[owner == 1])
    assert len(set(a[owner == 1]) & set(a[owner == 0])) > 0.99 * (owner == 1).sum()


def test_spans_of_unhappy_tables(spark):
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    a, b = prose(1, 40), prose(2, 40)
    only = [None, None, None]
    # two texts of null id are two documents
    got = repeated_spans(table(spark, [(1, a, *only), (None, "own words first " + a, *only), (None, b, *only)])).collect()
    assert [r.doc_id for r in got] == [None]
    assert got[0].start >= len("own words first ")
    # rows with the same doc_id and text are copies; other texts of that doc_id are not
    got = sorted((r.doc_id, r.copy, r.start, r.end) for r in repeated_spans(table(spark, [(5, b, *only), (5, b, *only), (5, b, *only), (5, a, *only), (6, "one", *only), (6, "one", *only), (7, None, *only), (7, None, *only)]).repartition(4)).collect())
    assert got == [(5, 1, 0, len(b)), (5, 2, 0, len(b)), (6, 1, 0, 3)]
    # the copies' document still gives way to an earlier one
    got = sorted((r.doc_id, r.copy) for r in repeated_spans(table(spark, [(5, b, *only), (5, b, *only), (4, b, *only)])).collect())
    assert got == [(5, 0), (5, 1)]
