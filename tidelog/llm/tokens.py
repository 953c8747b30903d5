"""Whole texts to token ids with the tokenizers library, each distinct word once per worker.

A word-level BPE with white space dropped treats the words of a text independently, so a text's ids are its
words' ids in a row. Words are counted and looked up by Arrow among those that this worker keeps; of the others,
only pieces that it does not keep go through the library. Words that hold anything outside the plain repertoire
(Latin letters, digits, punctuation) take the library's own path.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .common import alone, keeps, release

#: Words, and pieces of words, that a worker keeps with their ids before the rarer half is dropped; the longest one's bytes.
CACHE_WORDS = 200_000
LONGEST = 64
#: Bytes of text handled at once.
CHUNK_BYTES = 8 << 20

#: Letters for which lower-casing and splitting agree everywhere: ASCII and Latin-1.
_LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº")
#: A word of letters, then of these, has one piece of each.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = re.compile(r"[\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's own splitting rule (fixed value).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@functools.cache
def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one printable character: its own, or the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ranges(first: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each range (each many), in a row."""
    full = each > 0
    first, each = first[full], each[full]
    if not len(each):
        return np.empty(0, np.int64)
    step = np.ones(int(each.sum()), np.int64)  # one further, but for a jump where a range begins
    step[0] = first[0]
    step[np.cumsum(each[:-1])] = first[1:] - first[:-1] - each[:-1] + 1
    return np.cumsum(step, out=step)


class Kept:
    """Strings met before with their ids, as one Arrow array of at most room strings of at most LONGEST bytes.

    When it is full, the half that the most batches had stays.
    """

    def __init__(self, room: int, dtype: np.dtype):
        self.room, self.strings = room, pa.array([], pa.string())
        self.ids = np.empty(0, dtype)  # in a row; each string has its first place, its count, and the batches it was in
        self.first, self.each, self.met = (np.empty(0, np.int64) for _ in range(3))

    def look_up(self, distinct: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each string its first place among them and its count; learn(strings) gives the ids and counts of new ones."""
        place = pc.fill_null(pc.index_in(distinct, value_set=self.strings), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(place < 0)
        self.met[place[place >= 0]] += 1
        if not len(new):
            return self.ids, self.first[place], self.each[place]
        strings = distinct.take(pa.array(new))
        fresh, count = learn(strings)
        ids = np.concatenate([self.ids, fresh])
        first, each = (np.append(kept, 0)[place] for kept in (self.first, self.each))
        first[new], each[new] = len(self.ids) + np.cumsum(count) - count, count
        self._keep(strings, ids, first[new], count)
        return ids, first, each

    def _keep(self, strings: pa.Array, ids: np.ndarray, first: np.ndarray, each: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(strings).to_numpy(zero_copy_only=False) <= LONGEST)
        stay = np.arange(len(self.strings))
        if len(stay) + len(short) > self.room:
            most = min(len(stay), self.room // 2)
            stay = np.sort(np.argsort(-self.met, kind="stable")[:most])
            short = short[: self.room - most]
            self.met[:] = 0
        self.strings = pa.concat_arrays([self.strings.take(pa.array(stay)), strings.take(pa.array(short))])
        first = np.concatenate([self.first[stay], first[short]])
        self.each = np.concatenate([self.each[stay], each[short]])
        self.met = np.concatenate([self.met[stay], np.ones(len(short), np.int64)])
        self.ids = ids[ranges(first, self.each)]
        self.first = np.cumsum(self.each) - self.each


class WordTokenizer:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Words met before are kept with their ids; the others are split, and their pieces met before are kept likewise.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        pattern = shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != _PIECES.pattern or shape["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path} is not a word-level BPE of the supported kind")
        self.size = self.full.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(self.size, bool)  # ids that end a piece
        self.last[[i for t, i in shape["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.special = [t["content"] for t in shape["added_tokens"]]
        self.bare = Tokenizer(self.full.model)  # the same vocabulary and merges, for ready pieces
        self.words, self.pieces = Kept(cache_words, self.dtype), Kept(cache_words, self.dtype)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct lower-case pieces in a row, and each one's count."""
        new = pieces.to_pylist()
        letters = [p if p.isascii() else "".join(map(byte_letters().__getitem__, p.encode())) for p in new]
        groups = [letters[k : k + 1000] for k in range(0, len(letters), 1000)]
        ids = np.array([i for e in self.bare.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False) for i in e.ids], self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != sum(map(bool, new)):
            raise ValueError("a piece of a text does not end in one token with the word's end")
        count = np.zeros(len(new), np.int64)
        count[np.fromiter(map(bool, new), bool, len(new))] = np.diff(ends, prepend=0)
        return ids, count

    def _split(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in a row, and each one's count."""
        stems, tails = pc.utf8_rtrim(words, _MARKS), pc.utf8_ltrim(words, _LETTERS)
        simple = pc.equal(pc.utf8_ltrim(stems, _LETTERS), "")
        for content in self.special:
            simple = pc.and_not(simple, pc.match_substring(words, content))
        at = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        odd = np.setdiff1d(np.arange(len(words)), at, assume_unique=True)
        extra, owned, foreign, holders = [], [], [], []
        for i, w in zip(odd.tolist(), words.take(pa.array(odd)).to_pylist(), strict=True):
            if not _PLAIN.fullmatch(w) or any(content in w for content in self.special):
                foreign.append(w)
                holders.append(i)
            else:
                parts = _PIECES.findall(w.lower())
                extra += parts
                owned += [i] * len(parts)
        pieces = pa.concat_arrays([pc.utf8_lower(stems.filter(simple)), tails.filter(simple), pa.array(extra, pa.string())]).dictionary_encode()
        ids, first, each = self.pieces.look_up(pieces.dictionary, self._learn)
        which = pieces.indices.to_numpy(zero_copy_only=False)
        first, each = first[which], each[which]
        owners = np.concatenate([at, at, np.array(owned, np.int64)])
        if foreign:
            found = [e.ids for e in self.full.encode_batch_fast(foreign, add_special_tokens=False)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            first = np.concatenate([first, len(ids) + np.cumsum(count) - count])
            ids = np.concatenate([ids, np.array([i for f in found for i in f], self.dtype)])
            each, owners = np.concatenate([each, count]), np.concatenate([owners, np.array(holders, np.int64)])
        order = np.argsort(owners, kind="stable")  # a word's pieces keep their order
        count = np.bincount(owners, weights=each, minlength=len(words)).astype(np.int64)
        return ids[ranges(first[order], each[order])], count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's bounds among them (one more than texts). A null has no ids."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        ids, first, each = self.words.look_up(flat.dictionary, self._split)
        which = flat.indices.to_numpy(zero_copy_only=False)
        n = each[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        return ids[ranges(first[which], n)], ends[bounds - bounds[0]]


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


keeps("tokens", tokenizer.cache_clear)


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch with at most so many bytes of text (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def encoded(batch: pa.RecordBatch, path: str, end_id: int | None, most: int = CHUNK_BYTES):
    """For each slice of the batch with at most so many bytes of text: the slice and its texts' id arrays, each with end_id after it."""
    alone("tokens")
    tok = tokenizer(path)
    for part in chunks(batch, most=most):
        ids, bounds = tok.encode(part.column("text"))
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        yield part, ids, bounds
    release()
