"""N-gram Jaccard self-join by chosen paths.

A text is the set of its word shingles. Texts with equal sets are one class,
represented once. A run of the join splits the representatives on sampled
shared tokens: a path is a sequence of sampled minima of the sets, and two sets
stay together as long as they share the sampled tokens. Buckets that are small,
or that splitting does not shrink because their sets are much alike, are
compared pair by pair, large ones in blocks. Several runs leave a pair at the
threshold apart with a chance below 1e-6.

A pair is counted in the first bucket that it shares, so no pair of a large
group is ever a row: buckets give, for each set, how many partners were counted
there, and which sets hang together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bytewords, common

WORDS = 5
THRESHOLD = 0.8
#: Minima of a set that paths sample from; also the sketch that rules pairs out before they are compared exactly.
MINIMA = 64
#: Paths that begin at the root, and that leave a bucket: with 9 and 3, a pair of similarity 0.8 meets at no leaf with a chance of about (0.2 + 0.8 * 0.009) ** 9 < 1e-6.
RUNS, BRANCHES = 9, 3
#: Largest bucket that is compared outright, most levels, and rows of a block of larger ones.
SMALL, LEVELS, BLOCK = 48, 4, 512
#: Shingles of a block of long texts, on the average; sets that are compared at a time have twice as many.
SHINGLES = 1_000_000
#: Equal minima of 64 that a pair needs to be compared exactly. At similarity 0.8, fewer come with a chance below 1e-7.
SKETCH_LEAST = 32
_C = np.random.default_rng(20240229).integers(1, 1 << 63, (MINIMA, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text one after another, and how many each has.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    data, offsets = bytewords.text_bytes(column)
    starts, ends, sizes = bytewords.spans(data, offsets, bytewords.GAPS)
    keys = bytewords.keys(data, starts, ends)
    n = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), n)
    first = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(first), np.uint64)
    length = np.minimum(sizes, words)[owner]
    for k in range(words):
        there = length > k
        at = np.minimum(first + k, len(keys) - 1)
        h = np.where(there, bytewords.mix(h * bytewords.BASE + keys[at] if len(keys) else h), h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return h[keep], np.bincount(owner[keep], minlength=len(sizes))


def minima(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, MINIMA) of 32-bit minima; sets without shingles get zeros."""
    out = np.zeros((len(sizes), MINIMA), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        heads = (np.cumsum(sizes) - sizes)[full]
        for k, (a, b) in enumerate(_C):
            out[full, k] = np.minimum.reduceat(((sets * a + b) >> np.uint64(32)).astype(np.uint32), heads)
    return out


def fingerprints(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set, which do not depend on the order of its shingles."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for salt in bytewords.mix(np.array([0x1234567, 0x89ABCDE], np.uint64)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytewords.mix(sets ^ salt), dtype=np.uint64)])
        out.append(bytewords.mix(total[upto[1:]] - total[upto[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, f1, f2 (fingerprint of the set), n (its size) and sketch (binary, MINIMA u32) of docs (doc_id, text)."""

    def rows(batch_iter):
        for batch in batch_iter:
            column = batch.column("text")
            for lo, hi in bytewords.parts(column):
                sets, sizes = shingle_sets(column.slice(lo, hi - lo))
                sketch = minima(sets, sizes)
                same = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*same, *map(pa.array, fingerprints(sets, sizes)), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in sketch], pa.binary())],
                    ["doc_id", "k1", "k2", "f1", "f2", "n", "sketch"],
                )
        common.release()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *common.text_keys(), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(rows, "doc_id long, k1 long, k2 long, f1 long, f2 long, n long, sketch binary")


def children(rows: DataFrame, level: int) -> DataFrame:
    """rows (bucket, rid, n, sketch) one level down: a bucket samples BRANCHES of the minima, and each gives a bucket of its own for each value.

    probe is one more minimum, by which a new bucket shows how much its sets are alike.
    """
    take = RUNS if level == 0 else BRANCHES

    def split(batch_iter):
        for batch in batch_iter:
            bucket = batch.column("bucket").to_numpy().view(np.uint64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, MINIMA)
            out, probes, row = [], [], np.arange(len(bucket))
            for j in range(take):
                seed = bytewords.mix(bucket + np.uint64(1 + j + 100 * level))
                # different minima for the paths of a bucket: one from each of `take` equal ranges
                width = MINIMA // take
                at = (j * width + (seed % np.uint64(width)).astype(np.int64)) if level else np.full(len(bucket), j)
                value = sketch[row, at].astype(np.uint64)
                out.append(bytewords.mix(bytewords.mix(seed ^ (value << np.uint64(32)) ^ value) + at.astype(np.uint64)))
                probes.append(sketch[row, (at + 1 + (out[-1] % np.uint64(MINIMA - 1)).astype(np.int64)) % MINIMA].astype(np.int64))
            same = [pa.concat_arrays([batch.column(c)] * take) for c in ("rid", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(probes)), *same], ["bucket", "probe", "rid", "n"])
        common.release()

    return rows.select("bucket", "rid", "n", "sketch").mapInArrow(split, "bucket long, probe long, rid long, n long")


def leaves(reps: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Leaf buckets of all runs: bucket, rid, size, weight (shingles of its sets); every rid is in a bucket once."""
    found, rows = [], reps.select(F.lit(0).cast("long").alias("bucket"), "rid", "n", "sketch")
    for level in range(LEVELS):
        down = scratch.store(children(rows, level), "down")  # read twice
        alike = down.groupBy("bucket", "probe").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_w"))
        sizes = alike.groupBy("bucket").agg(F.sum("_n").alias("size"), F.sum("_w").alias("weight"), F.max("_n").alias("_most")).where("size > 1")
        # splitting goes on while it would shrink a bucket; sets that mostly share one more minimum are alike and are compared
        leaf = (F.col("size") <= SMALL) | (F.col("_most") * 2 > F.col("size")) | F.lit(level == LEVELS - 1)
        # stored first, so that the join's exchanges stand alone and a bucket of many rows can be split among tasks
        sizes = scratch.store(sizes.select("bucket", "size", "weight", leaf.alias("leaf")), "sizes", few=True)
        met = scratch.store(down.select("bucket", "rid").join(sizes, "bucket"), "paths", few=True)
        found.append(met.where("leaf").select("bucket", "rid", "size", "weight"))
        more = met.where("NOT leaf").select("bucket", "rid")
        if level == LEVELS - 1 or more.isEmpty():
            break
        rows = more.join(reps.select("rid", "n", "sketch"), "rid")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def units(rows: DataFrame) -> DataFrame:
    """Rows of leaves dealt to units of comparison (bucket, a, b): a small bucket is one unit; of a large one, or one of long texts, a unit is two of its blocks."""
    by_rows = F.when(F.col("size") <= SMALL, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(BLOCK)))
    by_shingles = F.least(F.ceil(F.col("weight") / F.lit(SHINGLES)), F.col("size"))
    n = F.greatest(by_rows, by_shingles).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_n")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return other.withColumn("a", F.least("block", "_other")).withColumn("b", F.greatest("block", "_other")).drop("_n", "_other", "weight")


def in_units(rows: DataFrame, columns: list[str], judge, schema: str) -> DataFrame:
    """judge(table) for each unit, a dict of numpy arrays or lists of the columns; units of a task follow one another in a stream."""
    names = ["bucket", "a", "b", *columns]

    def run(batch_iter):
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            table = pa.Table.from_batches(held)
            out = judge({c: table.column(c).to_pylist() if pa.types.is_binary(table.schema.field(c).type) or pa.types.is_list(table.schema.field(c).type) else table.column(c).to_numpy() for c in names})
            if out is not None and len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [c.split()[0] for c in schema.split(", ")])

        for batch in batch_iter:
            if not batch.num_rows:
                continue
            k = [batch.column(c).to_numpy() for c in ("bucket", "a", "b")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            bounds = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                mine = tuple(int(x[lo]) for x in k)
                if mine != key and held:
                    yield from flush()
                    held = []
                key = mine
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()
            held = []
        common.release()

    return rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").select(*names).mapInArrow(run, schema)


def _earlier(lists: list, bucket: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether rows left[i] and right[i] share a leaf before this one."""
    lists = [np.asarray(x, np.int64) for x in lists]
    return common_counts([x[x < bucket] for x in lists], left, right) > 0


def _pairs(t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit: between its two blocks, or within its one."""
    if t["a"][0] == t["b"][0]:
        left, right = np.triu_indices(len(t["rid"]), 1)
        return left, right
    one, two = np.flatnonzero(t["block"] == t["a"][0]), np.flatnonzero(t["block"] == t["b"][0])
    return np.repeat(one, len(two)), np.tile(two, len(one))


def near(n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    return (small >= threshold * large - 1e-9) & (small > 0)


#: Pairs whose sketches are compared at a time.
PAIRS = 1 << 17


def _alike(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sketches share at least so many minima; most are ruled out by the first ones."""
    equal = np.zeros(len(left), np.int16)
    for at in range(0, MINIMA, 16):
        equal += (sketch[left, at : at + 16] == sketch[right, at : at + 16]).sum(1, dtype=np.int16)
        keep = equal >= least - (MINIMA - at - 16)
        left, right, equal = left[keep], right[keep], equal[keep]
    return left, right


def candidates(t: dict, threshold: float, least: int = SKETCH_LEAST):
    """Rows of a unit with a partner that their sketches do not rule out and that they first meet here."""
    left, right = _pairs(t)
    keep = near(t["n"], left, right, threshold)
    left, right = left[keep], right[keep]
    if not len(left):
        return None
    sketch = np.frombuffer(b"".join(t["sketch"]), np.uint32).reshape(-1, MINIMA)
    kept = [_alike(sketch, left[at : at + PAIRS], right[at : at + PAIRS], least) for at in range(0, len(left), PAIRS)]
    left, right = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    if not len(left):
        return None
    new = ~_earlier(t["leaves"], int(t["bucket"][0]), left, right)
    rows = np.unique(np.concatenate([left[new], right[new]]))
    return [t["bucket"][rows], t["a"][rows], t["b"][rows], t["block"][rows], t["rid"][rows]]


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Members that sets left[i] and right[i] share, by products of narrow parts of the table of sets and shared members."""
    part = np.cumsum([len(s) for s in sets]) // SHINGLES
    if len(sets) > 2 and part[-1] > 0 and len(left) > 2 * len(sets):
        out = np.zeros(len(left), np.int64)
        for code in np.unique(part[left] * (part[-1] + 1) + part[right]):
            mine = np.flatnonzero(part[left] * (part[-1] + 1) + part[right] == code)
            rows, place = np.unique(np.concatenate([left[mine], right[mine]]), return_inverse=True)
            out[mine] = _common([sets[i] for i in rows], place[: len(mine)], place[len(mine) :])
        return out
    return _common(sets, left, right)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    if not sum(map(len, sets)):
        return np.zeros(len(left), np.int64)
    sizes = np.array([len(s) for s in sets])
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), count[which] > 1
    column, owner = (np.cumsum(count > 1) - 1)[which[shared]], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        out += has @ has.T
    return np.rint(out[left, right]).astype(np.int64)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least row of each row's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def verified(t: dict, threshold: float):
    """Exact comparison in a unit: for each set its partners that are first met here (sets, and documents of theirs), and the least set it hangs together with."""
    left, right = _pairs(t)
    keep = near(t["n"], left, right, threshold)
    left, right = left[keep], right[keep]
    if not len(left):
        return None
    keep = ~_earlier(t["leaves"], int(t["bucket"][0]), left, right)
    left, right = left[keep], right[keep]
    if not len(left):
        return None
    sets = [np.frombuffer(x, np.uint64) for x in t["shingles"]]
    both = common_counts(sets, left, right)
    like = both >= threshold * (t["n"][left] + t["n"][right] - both) - 1e-9
    left, right = left[like], right[like]
    if not len(left):
        return None
    m = len(sets)
    partners = np.bincount(left, minlength=m) + np.bincount(right, minlength=m)
    docs = np.bincount(left, t["copies"][right], m) + np.bincount(right, t["copies"][left], m)
    order = np.argsort(t["rid"])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    root = forest(m, rank[left], rank[right])
    rows = np.flatnonzero(partners)
    return [t["rid"][rows], partners[rows].astype(np.int64), docs[rows].astype(np.int64), t["rid"][order][root[rank[rows]]]]


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """rid and root (least rid of its component) of all ends of edges (rid, near), by minimum labels with pointer jumps; rounds grow with the logarithm of a component's width."""
    both = scratch.store(edges.select("rid", "near").union(edges.select("near", "rid")).where("rid <> near").distinct(), "edges", few=True)
    labels = scratch.store(both.groupBy("rid").agg(F.min("near").alias("_low")).select("rid", F.least("rid", "_low").alias("root")), "labels", few=True)
    while True:
        # a neighbour's label, then the label's own label
        seen = both.join(labels.withColumnsRenamed({"rid": "near", "root": "_root"}), "near").groupBy("rid").agg(F.min("_root").alias("_low"))
        step = labels.join(seen, "rid").select("rid", F.least("root", "_low").alias("root"), F.col("root").alias("_was"))
        jump = step.select(F.col("rid").alias("root"), F.col("root").alias("_next"))
        new = scratch.store(step.join(jump, "root").select("rid", F.least("root", "_next").alias("root"), (F.least("root", "_next") < F.col("_was")).alias("_moved")), "labels", few=True)
        moved = new.where("_moved").limit(1).count()
        labels = new.select("rid", "root")
        if not moved:
            return labels


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, sketch_least: int = SKETCH_LEAST) -> DataFrame:
    """Self-join of docs (doc_id, text) on Jaccard similarity of five-word shingles, at least threshold.

    Result, a row for each row of docs: doc_id, copy_id (least doc_id of the rows
    with an equal shingle set), class_id (least doc_id of those it is linked with,
    over any number of links; its own copy_id if none), n_links (other rows that
    are similar enough, copies included), n_set_links (other distinct sets).
    Texts without words (null, empty) have no links, and are no copies of one
    another: class_id is their own doc_id. A doc_id may stand on several rows:
    each row is joined by its own text. Rows without a doc_id take part; copies
    and classes of such rows alone have a negative number. An empty table gives no
    rows; other columns of docs are ignored. sketch_least is the number of equal
    minima that rules a pair in for the exact comparison; 0 compares every pair
    that meets in a bucket.
    """
    return classified(docs, threshold, sketch_least).select("doc_id", "copy_id", "class_id", "n_links", "n_set_links")


def classified(docs: DataFrame, threshold: float = THRESHOLD, sketch_least: int = SKETCH_LEAST) -> DataFrame:
    """jaccard_join() with k1 and k2 (128 bits of a row's text), n (its shingles) and root, a number of its class (null without words); it is stored."""
    spark = docs.sparkSession
    with common.Scratch(spark, "join") as scratch, common.small_batches(spark):
        return common.stored(_classified(docs, threshold, sketch_least, scratch), "classes", few=True)


def _classified(docs: DataFrame, threshold: float, sketch_least: int, scratch: common.Scratch) -> DataFrame:
    every = scratch.store(profiles(docs), "profiles")
    full = every.where("n > 0")
    reps = full.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # numbered as they are stored: sets, not doc_ids, are what is joined
    reps = scratch.store(reps.withColumn("rid", F.monotonically_increasing_id()), "sets")
    leaf = scratch.store(leaves(reps, scratch), "leaves", few=True)
    paths = leaf.groupBy("rid").agg(F.array_sort(F.collect_list("bucket")).alias("leaves"))  # RUNS * BRANCHES ** (LEVELS - 1) at most
    known = scratch.store(reps.join(paths, "rid").select("rid", "n", "copies", "sketch", "leaves"), "known", few=True)
    unit = units(leaf).join(known, "rid")
    cand = in_units(unit, ["block", "rid", "n", "sketch", "leaves"], lambda t: candidates(t, threshold, sketch_least), "bucket long, a int, b int, block int, rid long")
    cand = scratch.store(cand, "candidates")
    sets = scratch.store(shingles_of(docs, cand.select("rid").distinct(), reps, scratch), "shingles")
    exact = cand.join(known.select("rid", "n", "copies", "leaves"), "rid").join(sets, "rid")
    links = scratch.store(in_units(exact, ["block", "rid", "n", "copies", "leaves", "shingles"], lambda t: verified(t, threshold), "rid long, partners long, docs long, near long"), "links")
    counts = links.groupBy("rid").agg(F.sum("partners").alias("_sets"), F.sum("docs").alias("_docs"))
    roots = components(links.select("rid", "near"), scratch)
    nameless = -(F.col("f1").bitwiseAND(F.lit((1 << 62) - 1))) - 1
    # a class goes by its least doc_id, or by a negative number where none of its rows has one
    first = roots.join(reps.select("rid", "id", nameless.alias("_none")), "rid").groupBy("root").agg(F.min("id").alias("_first"), F.min("_none").alias("_none"))
    first = scratch.store(first.select("root", F.coalesce("_first", "_none").alias("class_id")), "class-ids", few=True)
    by_class = roots.join(first, "root")
    own = F.coalesce("id", nameless)
    by_set = reps.join(counts, "rid", "left").join(by_class, "rid", "left").select(
        "f1", "f2", F.coalesce("root", "rid").alias("root"), own.alias("copy_id"), F.coalesce("class_id", own).alias("class_id"),
        (F.coalesce("_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("_sets", F.lit(0)).alias("n_set_links"),
    )
    columns = ["doc_id", "copy_id", "class_id", "n_links", "n_set_links", "k1", "k2", "n", "root"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    bare = every.where("n = 0").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_set_links"), "k1", "k2", "n", none.alias("root"))
    return full.select("doc_id", "k1", "k2", "f1", "f2", "n").join(by_set, ["f1", "f2"]).select(columns).unionByName(bare.select(columns))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs less all but one row of each class of jaccard_join().

    The row with the least doc_id stays (of several with it, the one with the
    least hash of its text); in a class of rows without a doc_id, the one with the
    least text. Rows are told by doc_id and text, so a doc_id on several texts
    loses none that no other row resembles; of rows that are equal in both, one
    stays. Texts without words (null, empty) all stay. An empty table stays empty;
    the columns of docs stay as they are.
    """
    spark = docs.sparkSession
    with common.Scratch(spark, "keep") as scratch:
        classes = classified(docs, threshold).where("n > 0").select("root", "doc_id", "k1", "k2")
        rows = scratch.store(classes.groupBy("root", "doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")), "rows", few=True)
        name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
        best = rows.groupBy("root").agg(F.min(name).alias("_best"), F.count(F.lit(1)).alias("_n"))
        best = scratch.store(best.select("root", "_best.*", "_n"), "best", few=True)
        lone = rows.join(best.where("none AND _n > 1").select("root"), "root").select("root", "k1", "k2")
        if not lone.isEmpty():
            k1, k2 = common.text_keys()
            texts = docs.where(F.col("doc_id").isNull()).select(k1, k2, F.col("text").cast("string").alias("text"))
            least = texts.join(lone, ["k1", "k2"]).groupBy("root").agg(F.min("text").alias("text")).select("root", *common.text_keys())
            changed = best.join(least.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), "root", "left")
            best = scratch.store(changed.select("root", "none", "doc_id", F.coalesce("_k1", "k1").alias("k1"), F.coalesce("_k2", "k2").alias("k2")), "best", few=True)
        chosen = rows.join(best.select("root", F.col("doc_id").alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), "root")
        stays = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
        marked = common.stored(chosen.select("doc_id", "k1", "k2", "times", stays.alias("stays")).where("NOT stays OR times > 1"), "marked")
    keys = {"doc_id": F.col("doc_id").cast("long"), **dict(zip(("k1", "k2"), common.text_keys()))}
    out = common.without(docs, marked, keys)
    repeated = marked.where("stays")
    if repeated.isEmpty():
        return out
    again = common.with_only(docs, repeated, keys)
    plain = [c for c in docs.columns if c.lower() in ("doc_id", "text")]
    return out.unionByName(again.dropDuplicates(plain))


#: Sets whose numbers are sent to every executor at most (8 bytes each); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def shingles_of(docs: DataFrame, wanted: DataFrame, reps: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Shingle sets of wanted representatives (rid): rid, shingles (binary, sorted u64).

    The doc_id of a representative finds its rows, and the fingerprint of a row's
    set says whose it is; rows without a doc_id are all looked at where a wanted set
    has no other.
    """
    wanted = scratch.store(reps.join(wanted, "rid").select("rid", "id", "f1", "f2"), "wanted", few=True)
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = wanted.where("id IS NOT NULL").select("id").distinct()
    mine = texts.join(F.broadcast(ids) if few else ids, "id").select("text")
    if not wanted.where("id IS NULL").isEmpty():
        mine = mine.unionByName(texts.where("id IS NULL").select("text"))

    def rows(batch_iter):
        for batch in batch_iter:
            column = batch.column("text")
            for lo, hi in bytewords.parts(column):
                sets, sizes = shingle_sets(column.slice(lo, hi - lo))
                upto = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([*map(pa.array, fingerprints(sets, sizes)), pa.array([sets[a:b].tobytes() for a, b in zip(upto, upto[1:])], pa.binary())], ["f1", "f2", "shingles"])
        common.release()

    found = mine.mapInArrow(rows, "f1 long, f2 long, shingles binary")
    keyed = wanted.select("f1", "f2", "rid")
    # several rows may show one set: all of them the same shingles
    return found.join(F.broadcast(keyed) if few else keyed, ["f1", "f2"]).groupBy("rid").agg(F.first("shingles").alias("shingles"))


def chance_of_missing(similarity: float = THRESHOLD, runs: int = RUNS, branches: int = BRANCHES) -> float:
    """Chance that a pair meets at no leaf: it dies out under a bucket with the least solution of q = (1 - s + s q) ** branches."""
    q = 0.0
    for _ in range(200):
        q = (1 - similarity + similarity * q) ** branches
    return math.pow(1 - similarity + similarity * q, runs)


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.documents(spark, sf_dir, "doc_id", "text"))
