"""Whole texts to ids of a public tokenizer, with the pieces between spaces encoded once each."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space and line feed, as any regular-expression engine may see it.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
PIECES = re.compile("[ \n]*[^ \n]+|[ \n]+")
#: What sends a text to be encoded by itself: the same for Arrow's regular expressions, and white space in a row.
SPECIAL = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{2064}\\x{3000}\\x{feff}]|[ \\n][ \\n]"
#: Words that the normalisers of both vocabularies change in letter case at most, and keep as one pre-token.
WORD = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: A word that begins a line or is followed by an ASCII mark; the apostrophe isn't one, as it can belong to a word.
PARTED = re.compile(f"(\n?)({WORD})([!-&(-/:-@[-`{{-~].*)?", re.DOTALL)
ID = attrgetter("id")
#: A known piece is kept as the place of its ids and, in the lower bits, their number.
COUNT_BITS = 31


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts with the tokenizers library and keeps the ids of pieces it has met.

    A piece is a run of spaces and line feeds with the run of other characters behind it; what
    follows the letters of a word from an ASCII mark on, and a line feed in front of it, are encoded
    apart. Both vocabularies cut every text in these places before they merge anything (no pre-token
    has white space behind other characters, or a mark behind letters), so a text's ids are those of
    its pieces. Texts with other white space, or with the string of an added token, are encoded whole.
    Pieces are kept without the one space in front of them, others behind a tab, which no piece has.

    The memory is kept from task to task in two generations of at most `most` pieces and
    eight times as many ids (and what one call adds): when the young one is full it becomes the old one, and pieces met
    again move from the old to the young. So it is bounded, and frequent pieces stay.
    """

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens are cut out of the whole text before anything else; a normaliser may change letter case before that.
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.added_mark = re.match("[!-@[-`{-~]*", os.path.commonprefix(added)).group()
        self.most, self.most_ids = most, 8 * most
        #: Byte-level vocabularies write bytes as printable characters: those that print as they are, others from U+0100 on.
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
        self.bytes_as = dict(zip([b for b in range(256) if b not in shown], map(chr, range(256, 512)), strict=False))
        self.lower, self.merge = self.tokenizer.normalizer is not None, self.tokenizer.model.tokenize
        self.spaces = {" ": "" if self.tokenizer.model.end_of_word_suffix else self.bytes_as[32]}
        probe = ["a", "Straße", "THE", "Éÿ", "wqxzzk"]
        self.direct = all(self._word(x, y) == self.tokenizer.encode(y + x, add_special_tokens=False).ids for x in probe for y in ("", " "))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.old: dict[str, int] = {}
        self.old_ids = self.ids

    def age(self) -> None:
        """Makes room, if the young generation is full."""
        if len(self.known) > self.most or self.used > self.most_ids:
            known, ids = self.known, self.ids[: self.used].copy()
            self.clear()
            self.old, self.old_ids = known, ids

    def _word(self, word: str, space: str = " ") -> list[int]:
        """Ids of a plain word, with or without a space in front, by the vocabulary's merges alone."""
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.bytes_as)
        return list(map(ID, self.merge((self.spaces[space] + word) if space else word)))

    def learn(self, keys: set[str]) -> None:
        """Adds the ids of pieces that aren't known."""
        known, parted, plain, texts = self.known, {}, {}, set()
        if self.old and (again := [x for x in keys if x in self.old]):
            self._put(again, *self._ids(np.fromiter(map(self.old.__getitem__, again), dtype=np.int64, count=len(again)), self.old_ids))
            keys = keys.difference(again)
        direct, word_of, match = self.direct, self._word, PARTED.fullmatch
        merge, space, lower = self.merge, self.spaces[" "], self.lower
        for key in keys:
            if direct and key.isascii() and key.isalpha():
                plain[key] = list(map(ID, merge(space + (key.lower() if lower else key))))
                continue
            m = match(key)
            if m is None:
                texts.add(key)
                continue
            line, word, rest = m.groups()
            bare = "\t" + word if line else word
            if line or rest:
                parted[key] = parts = ["\t\n", bare] if line else [bare]
                if rest:
                    parts.append("\t" + rest)
                    texts.add(parts[-1])
            if bare not in known and bare not in plain:
                if direct:
                    plain[bare] = word_of(word, "" if line else " ")
                else:
                    texts.add(bare)
        texts.add("\t\n")
        texts = [x for x in texts if x not in known]
        if plain:
            self._put_lists(plain, list(plain.values()))
        if texts:
            whole = [x[1:] if x[:1] == "\t" else x if x[:1] == "\n" else " " + x for x in texts]
            self._put_lists(texts, [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        if parted:
            ids, counts = self._ids(np.array([self.known[x] for parts in parted.values() for x in parts], dtype=np.int64))
            sizes = np.fromiter(map(len, parted.values()), dtype=np.int64, count=len(parted))
            self._put(parted, ids, np.add.reduceat(counts, np.cumsum(sizes) - sizes))

    def _put_lists(self, keys: list[str], lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self._put(keys, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(counts.sum())), counts)

    def _put(self, keys, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = self.used + np.cumsum(counts)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : ends[-1]] = ids
        self.known.update(zip(keys, ((ends - counts) << COUNT_BITS | counts).tolist(), strict=True))
        self.used = int(ends[-1])

    def _ids(self, at: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        counts = at & ((1 << COUNT_BITS) - 1)
        ends = np.cumsum(counts)
        where = np.repeat((at >> COUNT_BITS) - (ends - counts), counts)
        where += np.arange(len(where))
        return (self.ids if ids is None else ids)[where], counts

    def _at(self, keys: list[str]) -> np.ndarray:
        """Where the ids of pieces are; those not known are learnt."""
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        if len(new := np.flatnonzero(at < 0)):
            missing = [keys[k] for k in new.tolist()]
            self.learn(set(missing))
            at[new] = list(map(self.known.__getitem__, missing))
        return at

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if OTHER_SPACE.search(text) or self.added_mark in text and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        self.age()
        return self._ids(self._at(["\t" + x for x in PIECES.findall(text)]))[0]

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with the end id behind each, and the number of ids of each text. Null is an empty text.

        Words are parted and gathered by Arrow, so each piece is looked up once for all texts.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        special = np.asarray(pc.match_substring_regex(texts, SPECIAL))
        if self.added_mark:
            special |= np.asarray(pc.match_substring(texts, self.added_mark))
        else:
            special |= np.asarray(pc.match_substring_regex(texts, self.added.pattern, ignore_case=True))
        counts = np.zeros(len(texts), dtype=np.int64)
        alone = {k: self.encode(texts[k].as_py()) for k in np.flatnonzero(special).tolist()}
        counts[list(alone)] = [len(x) for x in alone.values()]
        ids = np.zeros(0, dtype=np.uint32)
        if len(plain := np.flatnonzero(~special)):
            self.age()
            lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~special)), "\n", " \n"), " ")
            begin = np.asarray(lists.offsets)[:-1]
            coded = lists.values.dictionary_encode()
            # the first piece of a text has no space in front
            keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = self._at(keys + ["\t" + x for x in lists.values.take(pa.array(begin)).to_pylist()])
            at = found[np.asarray(coded.indices)]
            at[begin] = found[len(keys) :]
            ids, sizes = self._ids(at)
            counts[plain] = np.add.reduceat(sizes, begin)
        ends = np.cumsum(counts + 1) - 1
        out = np.zeros(int(counts.sum()) + len(counts), dtype=np.uint32)
        room = np.repeat(~special, counts + 1)
        room[ends] = False
        out[room] = ids
        out[ends] = end_id
        for k, x in alone.items():
            out[ends[k] - len(x) : ends[k]] = x
        return out, counts + 1


def encoded(coder: Encoder, batch: pa.RecordBatch, end_id: int, most_bytes: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each row of a batch, which is encoded in parts of about so many bytes of text."""
    names, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(most_bytes, int(ends[-1]), most_bytes)).tolist(), len(names)]).tolist() if len(names) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        ids, counts = coder.encode_batch(texts.slice(a, b - a), end_id)
        at = 0
        for name, n in zip(names[a:b], counts.tolist(), strict=True):
            yield name, ids[at : at + n]
            at += n


@lru_cache(maxsize=1)
def encoder(path: str, most: int) -> Encoder:
    """One for each worker process."""
    return Encoder(path, most)
