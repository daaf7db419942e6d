import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, awkward, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessel.llm.common import Scratch
from tessel.llm.packing import Packer, pack
from tessel.llm.token_files import decode_segment, encode_segment, read_token_files, write_token_files
from tessel.llm.tokens import Encoder, vocabulary_path

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
ENCODERS = {x: Encoder(x, most=50) for x in (BYTE, WORD)}
FRESH = {x: Tokenizer.from_file(x) for x in (BYTE, WORD)}
crc = lambda ids: zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def whole(path, text):
    return FRESH[path].encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcÉ.,*<!-_;é'sß1²\n\n  \t\r\x0b\x1c\x85\xa0 .,#́Σ漢"), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    for path, encoder in ENCODERS.items():
        assert encoder.encode(text).tolist() == whole(path, text)[:-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aBcÉ.,*-;é'sß1\n    \t\xa0\u2003,漢<|"), max_size=30) | st.just("x <|endoftext|> y"), max_size=9))
def test_batches_give_the_ids_of_each_text(texts):
    for path, encoder in ENCODERS.items():
        ids, counts = encoder.encode_batch(pa.array(texts, type=pa.string()), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [whole(path, x) for x in texts] if texts else len(ids) == 0


def test_pieces_move_between_generations():
    coder = Encoder(BYTE, most=30)
    rng = random.Random(2)
    words = [f"w{k}x" for k in range(60)]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(12))
        assert coder.encode_batch(pa.array([text, "", text[3:]]), 2)[0].tolist() == whole(BYTE, text) + [2] + whole(BYTE, text[3:])
        assert len(coder.known) < 30 + 80
        assert len(coder.old) < 30 + 80


def test_a_piece_of_very_many_ids():
    coder = Encoder(BYTE)
    coder._put(["\tx"], np.ones(1 << 24, dtype=np.uint32), np.array([1 << 24]))
    assert len(coder._ids(coder._at(["\tx"]))[0]) == 1 << 24


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDofText|>", "<|endoftext", "<|", "|>", "a", "É", " ", "\n", ".", "  "]), max_size=12))
def test_added_tokens_are_those_of_the_plain_call(parts):
    for path, encoder in ENCODERS.items():
        assert encoder.encode("".join(parts)).tolist() == FRESH[path].encode("".join(parts), add_special_tokens=False).ids


def test_the_string_of_an_added_token_is_one_id():
    got = [ENCODERS[x].encode("a <|endoftext|> b").tolist() for x in (BYTE, WORD)]
    assert got == [[64, 220, 50256, 275], [320, 49407, 321]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["byte", "bit"]), st.integers(1, 40), st.integers(0, 300), st.integers(0, 300))
def test_planes_round_trip(ids, planes, block, a, b):
    ids = np.array(ids, dtype=np.uint32)
    index, payload = encode_segment(ids, planes, block)
    assert (decode_segment(payload, index, len(ids), planes, block) == ids).all()
    low, high = min(a, b), max(a, b)
    assert (decode_segment(payload, index, len(ids), planes, block, low, high) == ids[low:high]).all()


def hostile():
    """Rows with added tokens' strings, null and repeated ids, and a long text without spaces."""
    text = "a <|endoftext|> b\n<|startoftext|>"
    return [*awkward(), (None, text, "en", "s", 1), (None, "null id", "en", "s", 1), (10, text, "en", "s", 1), (10, "other", "en", "s", 1), (50, "abc,de" * 30_000, "en", "s", 1)]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_every_document_in_order(spark, planes):
    rows = hostile()
    path = Scratch(spark, "t").path("set")
    write_token_files(table(spark, rows, True).repartition(3), path, BYTE, planes=planes, block_ids=64, segment_ids=500)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for row, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1])), strict=True):
        ids = whole(BYTE, text)
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, start, len(ids), np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_files_of_an_empty_table(spark):
    path = Scratch(spark, "t").path("set")
    write_token_files(spark.createDataFrame([], SCHEMA), path, BYTE)
    assert read_token_files(spark, path).count() == 0


def check_packed(got, rows, size):
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text, *_ in rows:
        ids, at = whole(WORD, text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, zlib.crc32(bytes(r.ids))) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


@pytest.mark.parametrize("open_windows", [1, 4])
def test_each_id_lies_in_one_piece(spark, open_windows):
    rows = awkward()
    got = pack(table(spark, rows, True).repartition(7), WORD, size=256, open_windows=open_windows, waste=4, group=2).collect()
    assert check_packed(got, rows, 256) < 0.02 * sum(r.length for r in got)


def test_nothing_to_pack(spark):
    assert pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5), st.integers(0, 6))
def test_packer_bounds_open_windows(lengths, most, waste):
    packer, closed = Packer(32, most, waste), []
    for k, n in enumerate(lengths):
        closed += packer.add(k, 0, n)
        assert len(packer.open) <= most
    assert all(sum(x[2] for x in w) >= 32 - waste for w in closed)
    closed += packer.drain()
    got = {}
    for w in closed:
        for k, start, n in w:
            got.setdefault(k, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(got[k]):
            assert start == at
            at += m
        assert at == n
