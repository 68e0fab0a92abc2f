"""Whole texts to token ids with a public tokenizers file, batch by batch.

Most texts repeat most of their words, so a batch is cut at blanks where the
file's rules never join tokens, the library encodes each distinct piece once,
and numpy lays the ids out again. Files whose rules are not known to allow such
cuts are encoded text by text.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import bytewords

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x0A]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Marks that the split pattern always cuts from a letter or digit before them, at a piece's end.
TAILS = ".,;:!?|"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_blanks(spec: dict) -> bool:
    """Whether blanks only separate tokens: all are folded into one, and the split pattern, which keeps matches only, has no class that takes one."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    folds = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    plain = all(s.get("type") in {"NFC", "Replace", "Lowercase"} for s in steps)
    split = (pre.get("pretokenizers") or [pre])[0]
    pattern = str((split.get("pattern") or {}).get("Regex", " "))
    keeps = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
    takes_none = " " not in pattern and "\\s" not in pattern.replace("[^\\s", "") and "." not in pattern
    own = all(not a.get("lstrip") and not a.get("rstrip") and " " not in a["content"] and "\n" not in a["content"] for a in spec.get("added_tokens", []))
    return folds and plain and keeps and takes_none and own


class Encoder:
    """ids of text columns; the distinct pieces seen so far are remembered up to max_pieces, then forgotten."""

    def __init__(self, path: str, max_pieces: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cuts = cuts_at_blanks(spec)
        self.max_pieces = max_pieces
        self.small = any(s.get("type") == "Lowercase" for s in (spec.get("normalizer") or {}).get("normalizers", []))
        mark = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if mark:
            self.ends = np.zeros(self.vocab_size, bool)
            self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(mark)]] = True
        self.tail_ids = np.zeros(256, np.int64)
        if self.cuts:
            self.tail_ids[list(TAILS.encode())] = [x[0] if len(x) == 1 else 0 for x in self._each(list(TAILS))]
        self._forget()

    def _forget(self) -> None:
        self.known = bytewords.Known()
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), 0

    def _each(self, pieces: list[str]) -> list:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words one after another, and how many each has.

        Words of letters only reach the library as one text, in which each of
        them ends in one token with the end mark.
        """
        if self.ends is not None and len(words) > 1:
            ids = np.array(self._each([" ".join(words)])[0], np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):
                return ids, np.diff(ends, prepend=0)
        coded = self._each(words)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for x in coded for i in x), np.uint32, int(lengths.sum())), lengths

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        for some in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for at in range(0, len(some), 5000):
                part = some[at : at + 5000]
                ids, lengths = self._ids([words[i] for i in part]) if plain[part[0]] else self._ids_each([words[i] for i in part])
                need = self.used + len(ids)
                if need > len(self.flat):
                    self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, 2 * len(self.flat)) - self.used, np.uint32)])
                self.flat[self.used : need] = ids
                self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths)])
                self.used = need
                self.known.add(keys[part])

    def _ids_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self._each(words)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for x in coded for i in x), np.uint32, int(lengths.sum())), lengths

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column one after another (uint32), and how many each text has. Null counts as the empty text."""
        if not self.cuts:
            return self._ids_each([t or "" for t in column.to_pylist()])
        data, offsets = bytewords.text_bytes(column)
        starts, ends, per_text = bytewords.spans(data, offsets, BLANKS)
        # a last mark after an ASCII letter or digit is a token of its own
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
        tail = np.where((ends - starts > 1) & ALNUM[before], self.tail_ids[last], 0)
        cores = ends - (tail > 0)
        look = bytewords.LOWER[data] if self.small else data
        keys, place, inverse = bytewords.distinct(bytewords.keys(look, starts, cores))
        if self.known.n + len(keys) > self.max_pieces:
            self._forget()
        number = self.known.find(keys)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            raw = look.tobytes()
            self._learn(keys[fresh], [raw[starts[i] : cores[i]].decode() for i in place[fresh]])
            number[fresh] = self.known.find(keys[fresh])
        which = number[inverse]
        first = self.starts[which]
        sizes = self.starts[which + 1] - first + (tail > 0)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        gather = np.repeat(first - upto[:-1], sizes)
        gather += np.arange(len(gather))
        ids = self.flat[np.minimum(gather, len(self.flat) - 1)]
        marked = np.flatnonzero(tail)
        ids[upto[marked + 1] - 1] = tail[marked]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(per_text)])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
