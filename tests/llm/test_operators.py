import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonespark.llm import common, jaccard_join, licenses, lm_scores, matroska, mixing, quality, toxicity
from tonespark.llm.encoding import public_path

from .conftest import COLUMNS, ODD, SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = pytest.mark.parametrize("table", ["odd", "clashing"])


# ---- media -------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300_000), st.integers(0, 9))
def test_media_round_trip(n, seed):
    payload = matroska.padded(np.random.default_rng(seed).bytes(n))
    data = matroska.mux(payload)
    movie = matroska.demux(data)
    assert len(payload) % 64 == 0 and payload and matroska.track_bytes(data, movie) == payload
    assert movie.tracks == [{"number": 1, "kind": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8}]
    assert [c["cluster"] + movie.segment for c in movie.cues] == movie.clusters
    assert all(p.time_ns >= 0 for p in movie.packets)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=400) | st.integers(0, 70_000).map(bytes), min_size=1, max_size=9))
def test_laces(frames):
    block = matroska.laced_block(3, -7, frames)
    track, time, _, _, spans = matroska.frames_of(block, 0, len(block))
    assert (track, time) == (3, -7) and [block[a : a + n] for a, n in spans] == frames


def test_foreign_elements_xiph_lacing_and_unknown_sizes():
    e = matroska.element
    xiph = matroska.size_bytes(2) + b"\x00\x05\x02" + bytes([1, 255, 45]) + b"a" * 300 + b"b" * 7
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, xiph) + e(matroska.BLOCK_DURATION, b"\x05"))
    cluster = matroska.number(matroska.CLUSTER) + b"\xff" + e(matroska.TIMESTAMP, b"\x64") + group
    body = e(0xEC, b"void") + cluster + matroska.number(matroska.CLUSTER) + b"\xff" + e(matroska.TIMESTAMP, b"\xc8") + e(matroska.SIMPLE_BLOCK, matroska.laced_block(1, 1, [b"xyz"]))
    data = e(matroska.EBML, b"") + matroska.number(matroska.SEGMENT) + b"\x01" + b"\xff" * 7 + body
    got = [(p.track, p.time_ns // 10**6, p.size, p.cluster, p.lacing) for p in matroska.demux(data).packets]
    assert got == [(2, 105, 300, 0, "xiph"), (2, 105, 7, 0, "xiph"), (1, 201, 3, 1, "none")]


@pytest.mark.parametrize("damage", [lambda b: b[:-5], lambda b: b[:40] + b"\x00" * 20 + b[60:], lambda b: b"\x00" + b])
def test_damaged_media(damage):
    with pytest.raises(ValueError):
        matroska.demux(damage(matroska.mux(bytes(640))))


@TABLES
def test_media_of_odd_rows(request, table):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in matroska.digests(matroska.media(request.getfixturevalue(table))).collect())
    want = collections.Counter()
    for d, t, *_ in ODD:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want[(d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert got == want


def test_packets(spark, odd):
    made = matroska.media(odd.where("doc_id = 6"))
    rows = matroska.packets(made).collect()
    data = bytes(made.first().media)
    assert b"".join(data[r.start : r.start + r.size] for r in sorted(rows, key=lambda r: r.packet)).rstrip(b"\0") == b"word " * 30_000
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_media_of_nothing(none):
    assert matroska.digests(matroska.media(none)).count() == 0


# ---- mixing --------------------------------------------------------------------


def duck(sql, docs):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])))
    return collections.Counter(con.sql(sql).fetchall())


def odd_rows():
    return [dict(zip("doc_id text lang source n_chars".split(), r)) for r in ODD]


@TABLES
def test_mix_of_odd_rows(request, table):
    got = mixing.mix(request.getfixturevalue(table)).drop("source")
    want = duck(mixing.OP2_SQL, odd_rows())
    assert collections.Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in map(tuple, got.collect())) == collections.Counter({(k[0], k[1], k[2], round(k[3], 6), k[4]): n for k, n in want.items()})


def test_mix_against_sql(spark, docs):
    assert collections.Counter(map(tuple, mixing.op2_mix_schedule(spark, SF).collect())) == duck(mixing.OP2_SQL, [r.asDict() for r in docs.collect()])


def test_targets_by_rounds(spark):
    r = np.random.default_rng(3)
    sizes = [(f"s{i:02d}", int(x)) for i, x in enumerate(r.integers(1, 5000, 25))] + [(None, 40)]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(sizes)}
    cap, free, target, left = {s: 2 * n for s, n in sizes}, dict(sizes), {}, 1.5 * sum(n for _, n in sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap[s]]
        for s in over or list(free):
            target[s] = cap[s] if over else weight[s] * level
            left -= target[s]
            del free[s]
    assert all(math.isclose(got[s], target[s], rel_tol=1e-9) for s in target)


def test_schedule(spark):
    table = spark.createDataFrame([("a", 0, 10_000, 15_000.0, 15_000), ("b", 1, 50, 100.0, 100), ("c", 2, 100_000, 200_000.0, 200_000), ("d", 3, 0, 0.0, 0)], "source string, source_no int, source_size long, target double, words long")
    rows = mixing.schedule(table, 64).orderBy("slot").collect()
    taken = collections.Counter()
    for r in rows:
        taken[r.source_no] += r["take"]
    assert taken == {0: 15_000, 1: 100, 2: 200_000} and len({r.slot for r in rows}) == len(rows)
    # every prefix is near the shares
    seen, total = collections.Counter(), collections.Counter(r.source_no for r in rows)
    for i, r in enumerate(rows, 1):
        seen[r.source_no] += 1
        assert abs(seen[2] - i * total[2] / len(rows)) < 15


def test_take(spark, clashing):
    got = collections.Counter((r.doc_id, r.text) for r in mixing.take(clashing).collect())
    assert set(got) <= {(r[0], r[1]) for r in ODD} and all(n <= 4 for n in got.values())
    assert mixing.take(clashing).columns == clashing.columns


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


# ---- quality ---------------------------------------------------------------------


def base(text):
    words = WORDS.findall(text or "")
    triples = list(zip(words, words[1:], words[2:]))
    times = collections.Counter(triples)
    covered = {k for i, t in enumerate(triples) if times[t] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def js(counts, reference):
    n = max(sum(counts), 1)
    p = [c / n for c in counts]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, reference)]
    return math.sqrt(max(0.0, (kl(p, m) + kl(reference, m)) / 2))


def classes(text):
    space, upper = sum(c in " \t\n\x0b\x0c\r" for c in text), len(re.findall("[A-ZÀ-ÖØ-Þ]", text))
    rest = [len(re.findall(p, text)) for p in (r"[0-9]", r"[.,;:'\"?()\-]", r"[!#$%&*+/<=>@\[\\\]^_`{|}~]")]
    return [space, upper, *rest, len(text) - space - upper - sum(rest)]


@TABLES
def test_quality_of_odd_rows(request, table):
    rows = quality.quality(request.getfixturevalue(table)).collect()
    want = collections.Counter((r[0], *base(r[1])) for r in ODD)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(not (r.base_failed and r.kept) for r in rows)


def test_quality_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in quality.op1_divergence(spark, SF).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    hists = {d: classes(r.text) for d, r in rows.items()}
    by_lang, by_words = collections.defaultdict(list), collections.defaultdict(list)

    def listed(r):
        plain = [w.lower().translate({ord(c): None for c in ".,;:!?"}) for w in WORDS.findall(r.text) if len(w) <= 6]
        times = [plain.count(x) for x in quality.COMMON[r.lang]]
        return [*times, base(r.text)[0] - sum(times)]

    for d, r in rows.items():
        if not base(r.text)[5] and len(r.text) >= 200:
            by_lang[r.lang].append([c / len(r.text) for c in hists[d]])
            by_words[r.lang].append([c / base(r.text)[0] for c in listed(r)])
    refs, word_refs = ({k: np.mean(v, axis=0).tolist() for k, v in x.items()} for x in (by_lang, by_words))
    for d, r in rows.items():
        g = got[d]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base(r.text)
        if len(r.text) < 200:
            assert g.char_distance is None
        else:
            assert math.isclose(g.char_distance, js(hists[d], refs[r.lang]), abs_tol=1e-9)
        far = (g.char_distance or 0) > quality.MAX_CHARS or (g.word_distance or 0) > quality.MAX_WORDS
        assert g.kept == (not g.base_failed and not far)
        assert math.isclose(g.word_distance, js(listed(r), word_refs[r.lang]), abs_tol=1e-9)


@pytest.mark.parametrize("bits", [None, 31, 61])
def test_repeated_words_whatever_the_hash_has_left(spark, bits):
    r = np.random.default_rng(3)
    texts = [" ".join("a b c d a b c e f a b".split() * 3 + ["z"]), "a b c a b c", "a b c d", "a b", *(" ".join(f"w{k}" for k in r.integers(0, n, 400)) for n in (4, 20, 60))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.repeated_words(F.split("t", " "), bits).alias("n")).collect()
    assert {x.t: x.n for x in got} == {t: base(t)[4] for t in texts}


def test_quality_keeps_clean_and_drops_junk(spark, clashing):
    clean = " ".join(f"the w{i} of and to x{i}" for i in range(60)) + "."
    junk = " ".join(f"WORD{i}!!" for i in range(200))
    some = spark.createDataFrame([(i, clean.replace("w", f"v{i}"), "en", "a", 1) for i in range(40)] + [(99, junk, "en", "a", 1)], COLUMNS)
    kept = quality.keep_good(some)
    assert {r.doc_id for r in kept.collect()} == set(range(40)) and kept.columns == some.columns
    assert quality.keep_good(clashing).columns == clashing.columns


def test_long_texts_without_common_words_are_far(spark):
    rng = np.random.default_rng(1)
    listed, other = quality.COMMON["en"], [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lorn", "mint", "rast", "velt")]
    prose = lambda n, share: " ".join(str(rng.choice(listed if rng.random() < share else other)) for _ in range(n)) + "."
    texts = [prose(300, 0.25) for _ in range(60)] + [prose(600, share) for share in (0.0, 0.01, 0.02)]
    rows = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], COLUMNS)).collect()}
    hists = [[ws.count(w) for w in listed] for ws in (x.rstrip(".").split() for x in texts)]
    hists = [[*h, len(x.split()) - sum(h)] for h, x in zip(hists, texts)]
    reference = np.mean([np.array(h) / sum(h) for h in hists], axis=0).tolist()
    for i, h in enumerate(hists):
        assert not rows[i].base_failed and rows[i].char_distance < quality.MAX_CHARS
        assert math.isclose(rows[i].word_distance, js(h, reference), abs_tol=1e-9)
        assert rows[i].kept == (i < 60)


def test_quality_of_nothing(none):
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


# ---- language models ----------------------------------------------------------------


def brute_losses(rows, target, leave_one_out=True):
    t = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    v = t.get_vocab_size()
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in rows]
    pair, one, context = ([collections.Counter() for _ in range(2)] for _ in range(3))
    for d, x in ids:
        for k in (0, 1) if d in target else (1,):
            pair[k].update(zip([v, *x[:-1]], x))
            one[k].update(x)
            context[k].update([v, *x[:-1]] if x else [])
    out = []
    for d, x in ids:
        both = []
        for k in (0, 1):
            own = x if leave_one_out and (k or d in target) else []
            before = [v, *own[:-1]] if own else []
            pairs, ones, contexts = pair[k].copy(), one[k].copy(), context[k].copy()
            pairs.subtract(zip(before, own))
            ones.subtract(own)
            contexts.subtract(before)
            total = sum(ones.values())
            s = sum(-math.log((pairs[a, b] + lm_scores.MASS * (ones[b] + lm_scores.ADD) / (total + lm_scores.ADD * v)) / (contexts[a] + lm_scores.MASS)) for a, b in zip([v, *x[:-1]], x))
            both.append(s / max(1, len(x)))
        out.append((d, len(x), both[0], both[1], both[0] - both[1]))
    return out


def same_losses(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], round(r[2], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-9)


def test_losses_against_brute_force(spark, texts):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    same_losses(lm_scores.op6_cross_entropy(spark, SF).collect(), brute_losses(texts.items(), good))


@TABLES
def test_losses_of_odd_rows(request, spark, table, monkeypatch):
    monkeypatch.setattr(lm_scores, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(lm_scores, "SLICE_TOKENS", 30)
    target = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (8, "x"), (777, "x")], "doc_id long, extra string")
    for left_out in (True, False):
        got = lm_scores.score(request.getfixturevalue(table), target, leave_one_out=left_out).collect()
        same_losses(got, brute_losses([r[:2] for r in ODD], {1, 8}, left_out))


def test_losses_of_nothing(spark, none, odd):
    assert lm_scores.score(none, none).count() == 0 and lm_scores.score(odd, none).count() == len(ODD)


# ---- toxicity --------------------------------------------------------------------------


def test_windows_against_brute_force():
    r = np.random.default_rng(1)
    sizes = np.array([0, 3, 8, 9, 40, 0, 1])
    values = r.normal(size=sizes.sum())
    best, first, length = toxicity.windows(values, sizes, 8)
    at = 0
    for i, n in enumerate(sizes):
        own = values[at : at + n]
        want = max((own[k : k + 8].mean() for k in range(max(1, n - 7))), default=0.0) if n else 0.0
        assert math.isclose(best[i], want, abs_tol=1e-12) and length[i] == min(n, 8)
        if n:
            assert math.isclose(values[first[i] : first[i] + length[i]].mean(), want, abs_tol=1e-12)
        at += n


def synthetic(n, seed, bad=("idiot", "moron", "scum")):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("aeioulnrst"), r.integers(2, 9))) for _ in range(400)]
    out = []
    for i in range(n):
        words = list(r.choice(vocabulary, r.integers(5, 300)))
        if i % 3 == 0:
            words[int(r.integers(len(words)))] = str(r.choice(bad))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_model_learns_and_knows_misspellings():
    rows = synthetic(900, 0)
    model = toxicity.train([t for t, _ in rows], np.array([y for _, y in rows]))
    scorer = toxicity.Scorer(model)
    test = synthetic(300, 5)
    predicted = scorer.scores(pa.array([t for t, _ in test])) >= toxicity.THRESHOLD
    truth = np.array([y for _, y in test]) == 1
    assert (predicted & truth).sum() >= 0.9 * truth.sum() and (predicted & ~truth).sum() <= 0.05 * (~truth).sum()
    near = model.word_scores(["idiotic", "morons", "scumm", "lonest", "rialto"])
    assert near[:3].min() > near[3:].max()
    assert (scorer.scores(pa.array(["", None, " \n"])) < toxicity.THRESHOLD).all()


def test_scores_against_a_plain_loop(spark, odd):
    r = np.random.default_rng(4)
    model = toxicity.Model(r.normal(size=1 << toxicity.BUCKET_BITS), -0.5)

    def plain(text):
        words = [float(model.word_scores([w])[0]) for w in WORDS.findall(text or "")]
        width = min(len(words), model.width)
        best = max((sum(words[i : i + width]) / width for i in range(len(words) - width + 1)), default=0.0) if words else 0.0
        return 1 / (1 + math.exp(-(best + model.bias)))

    got = toxicity.score(odd, model).select("text", "score").collect()
    assert len(got) == len(ODD)
    for row in got:
        if not row.text or len(row.text) < 50_000:
            assert math.isclose(row.score, plain(row.text), abs_tol=1e-9)
    few = toxicity.keep_clean(odd, model, 0.5)
    assert few.columns == odd.columns and few.count() == sum(x.score < 0.5 for x in got)


def test_repeated_labelled_ids_train_alike(spark):
    rows = [(i, ("bad vile words " if i % 2 else "good kind words ") * 5) for i in range(40)]
    more = [(i, f"zzz {t}") for i, t in rows]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    a, b = (toxicity.fit(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows + more, more[::-1] + rows))
    assert np.array_equal(a.scores, b.scores) and a.bias == b.bias


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows = synthetic(300, 2)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    honest = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, honest), toxicity.fit(docs, lies)
    assert (a.scores == b.scores).all() and a.bias == b.bias


@TABLES
def test_toxicity_of_odd_rows(request, spark, table):
    docs = request.getfixturevalue(table)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels), "my_score").collect()
    assert len(rows) == len(ODD) and all(0 <= r.my_score <= 1 for r in rows)
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).where("score >= 0.7").count() == 0


def test_toxicity_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


# ---- licenses ------------------------------------------------------------------------------


def test_licenses_against_sql(spark, docs):
    assert collections.Counter(map(tuple, licenses.op8_license_scan(spark, SF).collect())) == duck(licenses.OP8_SQL, [r.asDict() for r in docs.collect()])


@TABLES
def test_licenses_of_odd_rows(request, table):
    got = [tuple(r) for r in licenses.scan(request.getfixturevalue(table)).collect()]
    assert got == [(8, "MIT", 1.0, 0)]


def test_long_and_scattered_templates(spark):
    notice = " ".join(f"term{i}" for i in range(200))
    text = "x " * 500 + " ".join(w for i, w in enumerate(notice.split()) if i % 40) + " All RIGHTS   reserved." + " y" * 99
    docs = spark.createDataFrame([(1, text), (2, "term1 term2 term3"), (3, "all rights are reserved")], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(docs, {"long": notice, "ARR": "All rights reserved."}).collect()}
    assert got == {(1, "long"), (1, "ARR")}
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "two words"})


def test_bands_and_nothing(none):
    b = licenses.bands_for(0.5, 0.99)
    assert 1 - 0.5**b >= 0.99 > 1 - 0.5 ** (b - 1)
    assert licenses.scan(none).count() == 0


# ---- near copies --------------------------------------------------------------------------------


def shingles(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows):
    """class and links of each row, for rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    root, links = {d: d for d in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def near_copies(n, seed, length=60, changes=3):
    r = np.random.default_rng(seed)
    base_words = [f"w{k}" for k in r.integers(0, 10**6, length)]
    out = []
    for _ in range(n):
        w = list(base_words)
        for k in r.integers(0, length, r.integers(0, changes)):
            w[k] = f"v{r.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_against_brute_force(spark, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.op9_chosen_path_join(spark, SF).collect()}
    assert got == brute_join(texts.items())


@pytest.mark.parametrize("small", [2, 48])
def test_groups_of_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    texts = near_copies(90, 1) + near_copies(60, 2, 200, 12) + near_copies(40, 3, 12, 2) + ["shared passage of more than five words here " + t for t in near_copies(30, 4, 30, 30)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_join(rows)


def test_every_pair_at_the_threshold(spark):
    r, rows, n = np.random.default_rng(9), [], 0
    for k in range(300):  # 40 shingles each, 36 or 35 of them shared: similarity 36/44 = 0.818 or 35/45 = 0.777
        words = [f"p{k}x{i}" for i in range(44)]
        cut = 36 if k % 2 else 35
        rows += [(n, " ".join(words)), (n + 1, " ".join(words[: cut + 4] + [f"q{k}x{i}" for i in range(40 - cut)]))]
        n += 2
    r.shuffle(rows)
    got = {x.doc_id: x.n_links for x in jaccard_join.jaccard_join(spark.createDataFrame([(int(d), str(t)) for d, t in rows], "doc_id long, text string")).collect()}
    assert got == {i: int(i // 2 % 2 == 1) for i in range(600)}
    assert jaccard_join.chance_of_missing() < 1e-6


@TABLES
def test_join_of_odd_rows(request, table):
    docs = request.getfixturevalue(table)
    rows = jaccard_join.jaccard_join(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ODD)
    by = collections.Counter((r.doc_id, r.class_id, r.n_links) for r in rows)
    assert by[(1, 1, 1)] == 2 and by[(3, 3, 0)] == 1 and by[(None, None, 0)] == 1
    kept = jaccard_join.keep_one(docs)
    want = collections.Counter((r[0], r[1]) for r in ODD)
    want[ODD[0][:2]] = 1
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want and kept.columns == docs.columns


def test_rows_without_ids(spark):
    a, b = near_copies(2, 7)
    docs = spark.createDataFrame([(None, a), (None, a), (None, b), (4, "else " * 9), (None, "else " * 9)], "doc_id long, text string")
    rows = jaccard_join.jaccard_join(docs).collect()
    assert len(rows) == 5 and {r.class_id for r in rows if r.n_links == 1} == {4}
    assert len({r.class_id for r in rows if r.class_id < 0}) == 1 and sorted(r.n_links for r in rows) == [1, 1, 2, 2, 2]


def test_one_row_of_each_class_without_ids(spark):
    a, b = near_copies(2, 7)
    c = near_copies(1, 11)[0]
    d = f"{c} more"
    assert a != b
    rows = [(None, a), (None, a), (None, b), (4, "else " * 9), (None, "else " * 9), (7, c), (None, c), (None, d), (None, ""), (None, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r.class_id for r in jaccard_join.jaccard_join(docs).collect() if r.class_id is not None}
    assert {x for x in classes if x > 0} == {4, 7} and len(classes) == 3
    got = collections.Counter(map(tuple, jaccard_join.keep_one(docs).collect()))
    assert got == collections.Counter([(None, min(a, b)), (4, "else " * 9), (7, c), (None, ""), (None, ""), (None, None), (None, None)])


def test_join_of_nothing(none):
    assert jaccard_join.jaccard_join(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def many_rows(seed):
    """Near and exact copies under repeated, missing and different ids."""
    r = np.random.default_rng(seed)
    texts = near_copies(8, seed) + near_copies(5, seed + 1) + ["one two three", "", None, "a lone text of some words"]
    return [(None if r.random() < 0.3 else int(r.integers(0, 6)), texts[r.integers(len(texts))]) for _ in range(40)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeated_ids_lose_nothing(spark, seed):
    """Rows are joined by their own texts, and one row of each class stays, whatever ids they have."""
    rows = [(0, "c " * 9), (3, "c " * 9), (3, "d e f g h i"), *many_rows(seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    brute = brute_join([(i, t) for i, (_, t) in enumerate(rows)])
    got = collections.Counter((r.doc_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == collections.Counter((rows[i][0], n) for i, (_, n) in brute.items())
    groups = collections.defaultdict(list)
    for i, (c, _) in brute.items():
        groups[c].append(rows[i])
    kept = collections.Counter(map(tuple, jaccard_join.keep_one(docs).collect()))
    for members in groups.values():
        if not shingles(members[0][1]):
            assert kept[members[0]] == sum(m == members[0] for m in rows)
            continue
        stay = [m for m in set(members) if kept[m]]
        assert len(stay) == 1 and kept[stay[0]] == 1
        assert stay[0][0] == min((m[0] for m in members if m[0] is not None), default=None)
    bare = sum(not shingles(t) for _, t in rows)
    assert sum(kept.values()) == bare + sum(bool(shingles(m[0][1])) for m in groups.values())


def test_one_id_on_different_texts(spark):
    a = near_copies(1, 5)[0]
    docs = spark.createDataFrame([(1, a), (1, "b " * 8), (2, f"{a} more")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()) == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_long_texts_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHINGLES", 100)
    rows = list(enumerate(near_copies(30, 1, 300, 20)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), sketch_least=0).collect()}
    assert got == brute_join(rows)


def test_nothing_is_left_behind(spark, docs, tmp_path, monkeypatch):
    """Intermediate tables go, and the caller's Arrow setting holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(common, "shared_dir", lambda _, name: f"file://{tmp_path}/{name}")
    assert jaccard_join.jaccard_join(docs).count() == docs.count()
    assert [p.name for p in tmp_path.iterdir()] == ["classes"] and spark.conf.get(key) == before


def components(spark, edges):
    with common.Scratch(spark, "test") as scratch:
        return jaccard_join.components(spark.createDataFrame(edges, "rid long, near long"), scratch).collect()


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(a) + 1) for a in range(0, 300) if a % 50 != 49] + [(int(x), int(y)) for x, y in r.integers(1000, 1100, (40, 2))]
    got = {x.rid: x.root for x in components(spark, edges)}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if any(a != b and n in (a, b) for a, b in edges)}


def test_running_sums(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumn("b", F.floor(F.col("o") / 50))
    got = {(r.k, r.o): (r.s, r.r) for r in common.running_sums(df, "k", "b", ["o"], "v", "s", "r").collect()}
    for k in ("a", None):
        total, n = 0, 0
        for kk, o, v in rows:
            if kk == k:
                assert got[(k, o)] == (total, n)
                total, n = total + v, n + 1
