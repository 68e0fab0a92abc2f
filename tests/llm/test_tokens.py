import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonespark.llm import bytewords, common, packing, token_counts, token_files
from tonespark.llm.encoding import Encoder, cuts_at_blanks, public_path

from .conftest import ODD, SF

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")
ALPHABET = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "'s", "'", "é", "1", "!", ".", ", ", "\x1c", " ", "the ", "<|endoftext|>", "\t", "\xa0", "́", "　", "ß", "İ", "aaaa"]), max_size=30).map("".join)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


ENCODER, COUNTER = Encoder(WORD), token_counts.Counter(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | ALPHABET, max_size=6))
def test_encoder_equals_library(some):
    ids, n = ENCODER.encode(pa.array(some, pa.string()))
    parts = np.split(ids, np.cumsum(n)[:-1]) if some else []
    assert [p.tolist() for p in parts] == [ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | ALPHABET, max_size=6))
def test_counter_equals_library(some):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_counter_equals_library, "t") else test_counter_equals_library.t
    test_counter_equals_library.t = t
    assert COUNTER.count(pa.array(some, pa.string())).tolist() == [len(t.encode(x or "", add_special_tokens=False).ids) for x in some]


def test_encoder_forgets_and_still_agrees(word, texts):
    small = Encoder(WORD, max_pieces=300)
    some = list(texts.values())[:40]
    for i in range(0, 40, 5):
        ids, n = small.encode(pa.array(some[i : i + 5]))
        assert ids.tolist() == [x for t in some[i : i + 5] for x in word.encode(t, add_special_tokens=False).ids]


def test_unknown_rules_are_not_cut():
    assert not cuts_at_blanks({"normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}, "model": {}})


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=300))), st.data())
def test_bit_packing_round_trip(case, data):
    bits, ids = case
    words = token_files.pack(np.array(ids, np.uint64), bits)
    assert len(words) == -(-len(ids) * bits // 64)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_files.unpack(words, bits, a, b).tolist() == ids[a:b]


def test_pack_refuses_wide_ids():
    with pytest.raises(ValueError):
        token_files.pack(np.array([8], np.uint64), 3)


def test_bits_for():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_random_access():
    ids, lengths = np.arange(50, dtype=np.uint32), np.array([20, 0, 30])
    image = token_files.block_bytes(7, [5, None, 9], lengths, ids, 0)
    import struct

    data = image + b"FWBD" + struct.pack("<I", 1) + np.array([0, 0, 0], "<u8").tobytes() + struct.pack("<Q", len(image)) + b"\n"
    f = token_files.TokenFile(data)
    assert f.block(0)[0] == [5, None, 9]
    assert [f.document(0, i).tolist() for i in range(3)] == [list(range(20)), [], list(range(20, 50))]


def test_files_against_library(spark, texts, word):
    got = {r.doc_id: r for r in token_files.op5_token_files(spark, SF).collect()}
    start = 0
    for d in sorted(texts):
        ids = word.encode(texts[d], add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_files_of_odd_rows(request, spark, table, word):
    rows = token_files.token_files(request.getfixturevalue(table), common.shared_dir(spark, "test")).collect()
    want = Counter((r[0], len(word.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))


def test_files_are_bounded(spark, docs, texts, word):
    """A partition of many blocks makes many files, and each is read alone."""
    path = common.shared_dir(spark, "test")
    token_files.write_files(docs.coalesce(1), path, public_path("word_bpe_49k.json"), block_ids=2000, file_blocks=3)
    back = token_files.read_files(spark, path).collect()
    want = {d: np.array([*word.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t in texts.items()}
    assert {r.doc_id: bytes(r.ids) for r in back} == want and len(back) == len(want)
    files = sorted({r.file for r in back})
    assert len(files) > 8 and any(f % (1 << 24) for f in files)
    ordered = [(r.doc_id, r.start) for f in files for r in sorted((r for r in back if r.file == f), key=lambda r: r.start)]
    assert [d for d, _ in ordered] == sorted(texts)


def test_files_of_nothing(spark, none):
    assert token_files.token_files(none, common.shared_dir(spark, "test")).count() == 0


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_counts_of_odd_rows(request, table, byte):
    got = Counter(map(tuple, token_counts.count_tokens(request.getfixturevalue(table)).collect()))
    want = Counter()
    for d, t, *_ in ODD:
        n = len(byte.encode(t or "", add_special_tokens=False).ids)
        want[(d, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want


def test_counts_against_library(spark, texts, byte):
    got = {r.doc_id: r.n_tokens for r in token_counts.op10_token_counts(spark, SF).collect()}
    assert got == {d: len(byte.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_counts_of_nothing(none):
    assert token_counts.count_tokens(none).count() == 0


def test_keys_and_spans():
    data, offsets = bytewords.text_bytes(pa.array(["a bb", None, " ", "bb a"]))
    starts, ends, n = bytewords.spans(data, offsets, bytewords.GAPS)
    k = bytewords.keys(data, starts, ends)
    assert n.tolist() == [2, 0, 0, 2] and k[0] == k[3] and k[1] == k[2] and k[0] != k[1]
    known = bytewords.Known()
    every = bytewords.mix(np.arange(1, 200_001, dtype=np.uint64))
    for part in np.split(every, 10):
        assert (known.find(part) == -1).all()
        known.add(part)
    assert (known.find(every) == np.arange(200_000)).all()


def check_packing(rows, capacity=packing.CAPACITY):
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=50))))
def test_solver(case):
    capacity, items = case
    count = dict(Counter(items))
    groups = packing.solve(count, capacity)
    got = Counter()
    for g in groups:
        assert sum(s * k for s, k in g.runs) + g.room == capacity and g.room >= 0
        for s, k in g.runs:
            got[s] += k * g.times
    assert got == Counter(items)
    plain = sum(g.times for g in packing.best_fit(dict(Counter(items)), capacity))
    assert sum(g.times for g in groups) <= plain
    lengths = np.array(sorted(items), np.int64)
    ranks = np.array([sorted(items)[:i].count(x) for i, x in enumerate(sorted(items))], np.int64)
    if len(items):
        sequence, offset = packing.place(packing.runs_table(groups), lengths, ranks)
        Row = type("Row", (), {})
        rows = []
        for s, o, n in zip(sequence, offset, lengths):
            r = Row()
            r.sequence_id, r.offset, r.length = s, o, n
            rows.append(r)
        check_packing(rows, capacity)


def optimal(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(2, 12), max_size=9))
def test_reduction_keeps_an_optimum(items):
    rest = dict(Counter(items))
    fixed = sum(g.times for g in packing.reduce_instance(rest, 12))
    left = [s for s, n in rest.items() for _ in range(n)]
    assert fixed + optimal(sorted(left, reverse=True), 12) == optimal(sorted(items, reverse=True), 12)


def test_packing_against_library(spark, texts, word):
    rows = packing.op3_pack_dominance(spark, SF).collect()
    want, total = Counter(), 0
    for d, t in texts.items():
        ids = word.encode(t, add_special_tokens=False).ids + [1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4")))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert check_packing(rows) <= 1.02 * total / 4096 + 1


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_packing_of_odd_rows(request, table, word):
    rows = packing.pack(request.getfixturevalue(table)).collect()
    check_packing(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r[0] for r in ODD)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in rows) == sum(len(word.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)


def test_packing_of_nothing(none):
    assert packing.pack(none).count() == 0
