"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie end to end in one array of symbols. Each round
finds every sequence's lowest-ranked adjacent pair, merges all places of that
pair in that sequence at once, and closes the gaps; sequences without a ranked
pair are finished. A merge makes pairs of higher rank only, so the rounds give
the same symbols as merging one pair at a time. What survives is counted.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords, common
from .encoding import public_path

#: The byte-level split pattern (fixed value of the tokenizer family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of this family: printable Latin-1 stays, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class PairTable:
    """Ranks and products of symbol pairs in an open-addressed table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        self.bits = max(4, int(4 * len(rank)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank, self.made = np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = self.keys[slot[todo]] == -1
            first = np.unique(slot[todo][free], return_index=True)[1]
            won = todo[free][first]
            self.keys[slot[won]], self.rank[slot[won]], self.made[slot[won]] = keys[won], rank[won], made[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or of a free place where the pair has no rank."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            open_ = open_[(self.keys[slot[open_]] != keys[open_]) & (self.keys[slot[open_]] != -1)]
        return slot


def merged_lengths(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols that each sequence keeps when no ranked pair is left."""
    out = lengths.astype(np.int64).copy()
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols.astype(np.int64)
    while len(symbols) > 1:
        slot = table.find(symbols[:-1], symbols[1:])
        rank = table.rank[slot]
        rank[owner[:-1] != owner[1:]] = NONE
        rank = np.append(rank, NONE)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        least = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(symbols)))
        live = least < NONE
        if not live.all():  # finished sequences leave the arrays
            out[owner[heads[~live]]] = sizes[~live]
            stay = np.repeat(live, sizes)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            slot = np.append(slot, 0)[stay]
            least, sizes = least[live], sizes[live]
            if not len(symbols):
                return out
        else:
            slot = np.append(slot, 0)
        hit = rank == np.repeat(least, sizes)
        at = np.flatnonzero(hit)
        # of overlapping places (a a a) the first, third, ... merge
        run = np.concatenate([[True], np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(at))))
        at = at[place % 2 == 0]
        symbols[at] = table.made[slot[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    if len(symbols):
        out[owner[0]] = 1
    return out


class Counter:
    """Tokens of whole texts for one tokenizers file of this family; counts of distinct pieces are remembered up to max_pieces."""

    def __init__(self, path: str, max_pieces: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files")
        vocab, letters = model["vocab"], byte_letters()
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        added = [a["content"] for a in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(PATTERN)
        self.max_pieces = max_pieces
        self._forget()

    def _pretokens(self, piece: str) -> tuple[int, list[str]]:
        """Special tokens in a piece, and the pre-tokens of what is between them."""
        if self.special is None or not self.special.search(piece):
            return 0, self.split.findall(piece)
        parts = self.special.split(piece)
        return len(parts) - 1, [w for part in parts for w in self.split.findall(part)]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        words: dict[str, int] = {}
        base = np.zeros(len(pieces), np.int64)
        of, per = [], np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            base[i], found = self._pretokens(p)
            per[i] = len(found)
            for w in found:
                of.append(words.setdefault(w, len(words)))
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        counts = merged_lengths(self.of_byte[np.frombuffer(b"".join(coded), np.uint8)], sizes, self.table)
        upto = np.concatenate([[0], np.cumsum(counts[np.array(of, np.int64)])])
        at = np.concatenate([[0], np.cumsum(per)])
        self.known.add(keys)
        self.counts = np.concatenate([self.counts, base + np.diff(upto[at])])

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column; null counts as empty."""
        data, offsets = bytewords.text_bytes(column)
        starts = pieces_at(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, place, inverse = bytewords.distinct(bytewords.keys(data, starts, ends))
        if self.known.n + len(keys) > self.max_pieces:
            self._forget()
        number = self.known.find(keys)
        fresh = np.flatnonzero(number < 0)
        raw = data.tobytes() if len(fresh) else b""
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            self._learn(keys[some], [raw[starts[i] : ends[i]].decode() for i in place[some]])
        number[fresh] = self.known.find(keys[fresh])
        upto = np.concatenate([[0], np.cumsum(self.counts[number[inverse]])])
        return np.diff(upto[np.searchsorted(starts, offsets)])

    def _forget(self) -> None:
        self.known, self.counts = bytewords.Known(), np.zeros(0, np.int64)


def pieces_at(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin that hold whole pre-tokens: at each text, and at blanks between two characters that are surely no white space."""
    n = len(data)
    solid = data > 0x20
    wide = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))  # lead bytes of other white space
    ok = solid.copy()
    ok[1:] &= ~(wide[:-1] & (data[:-1] == 0xC2))  # last bytes after such leads
    ok[2:] &= ~(wide[:-2] & (data[:-2] != 0xC2))
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 0x20) & ok[:-2] & solid[2:] & ~wide[2:]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    inner = np.flatnonzero(first[:-1])
    cut[np.maximum(inner - 1, 0)] = False  # a blank that ends a text stays with it
    cut[inner] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text).

    Null and empty texts have 0 of both; rows repeat as often as in docs; an empty
    table gives no rows; other columns of docs are ignored.
    """
    path = tokenizer or public_path("byte_bpe_50k.json")

    def rows(batch_iter):
        for batch in batch_iter:
            texts = batch.column("text")
            n = [counter(path).count(texts.slice(lo, hi - lo)) for lo, hi in bytewords.parts(texts)]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = plain.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
    with common.small_batches(docs.sparkSession):
        counted = common.stored(counted, "token-counts")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir, "doc_id", "text"))
