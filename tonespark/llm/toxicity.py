"""Toxicity from bags of subword vectors under a linear softmax, trained jointly in numpy.

A word's vector is the mean of its character n-grams' vectors, so an unseen
spelling is near the words it shares n-grams with. Vectors are averaged over
windows of a few words, and one linear softmax scores the mean. A text scores as
its most toxic window: a slur is not diluted by the length of a text, and no
part of the text is left out. Training alternates the same way: the window that
scores highest stands for its text, and vectors and softmax move together.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords, common

BUCKET_BITS = 17
DIMENSIONS = 8
WINDOW = 8
#: Labelled rows of each class that are used for training, at most.
TRAIN_ROWS = 1000
#: Words of the windows that training begins with.
WARM = 64
THRESHOLD = 0.7
EDGES = "\"'()[]{}<>.,;:!?*#$%&|-_…«»“”’"


def words_of(text: str | None) -> list[str]:
    return re.findall(common.WORD, text or "")


def ngrams(words: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of 3 to 5 letters of <word> and of the word itself, ordered by word."""
    plain = [f"<{w.lower().strip(EDGES)}>" for w in words]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    letters = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, hashes = [np.arange(len(words))], [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in plain), np.uint64, len(plain))]
    h = letters.copy()
    for n in range(2, 6):
        h = h[:-1] * np.uint64(1_000_003) + letters[n - 1 :]
        if n >= 3 and len(h):
            whole = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][whole])
            hashes.append(h[whole] + np.uint64(n))
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(owner, kind="stable")
    return owner[order], (h >> np.uint64(64 - bits)).astype(np.int64)[order]


def packed_ngrams(words: list[str], part: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams one after another, and where each word's begin; worked out in parts to hold little at once."""
    buckets, counts = [], []
    for at in range(0, len(words), part):
        owner, bucket = ngrams(words[at : at + part])
        buckets.append(bucket.astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(words[at : at + part])))
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def windows(values: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of `sizes` values: mean, first place and length of its highest window of `width` values (all values where it has fewer; 0 for none)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = np.concatenate([[0.0], np.cumsum(values)])
    best, first, length = np.zeros(len(sizes)), starts.copy(), np.minimum(sizes, width)
    short = (sizes < width) & (sizes > 0)
    best[short] = (total[ends[short]] - total[starts[short]]) / sizes[short]
    long = np.flatnonzero(sizes >= width)
    if len(long):
        n = sizes[long] - width + 1
        heads = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(heads, n) + np.repeat(starts[long], n)
        sums = total[at + width] - total[at]
        best[long] = np.maximum.reduceat(sums, heads) / width
        hit = np.flatnonzero(sums >= np.repeat(best[long] * width, n) - 1e-12)
        owner = np.repeat(np.arange(len(long)), n)[hit]
        one = np.unique(owner, return_index=True)
        first[long[one[0]]] = at[hit[one[1]]]
    return best, first, length


@dataclass
class Model:
    """Scores of buckets (the softmax' margin of each n-gram vector), bias, and the window's width."""

    scores: np.ndarray
    bias: float
    width: int = WINDOW

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        owner, bucket = ngrams(words)
        return np.bincount(owner, self.scores[bucket], len(words)) / np.bincount(owner, minlength=len(words))


def train(texts: list[str], toxic: np.ndarray, epochs: int = 40, seed: int = 7, rate: float = 0.3) -> Model:
    """Fit vectors and softmax on texts: the first epochs on random windows of each text, the others on its highest window."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    of = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    if not number or len(set(toxic.tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), -20.0 if not toxic.any() else 0.0)
    bucket, heads = packed_ngrams(list(number))
    del number
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    seen, seen_softmax, seen_bias = np.full((1 << BUCKET_BITS, DIMENSIONS), 1e-8), np.full(softmax.shape, 1e-8), np.full(2, 1e-8)
    flat, sizes = np.concatenate(of), np.array([len(x) for x in of])
    truth = np.stack([1 - toxic, toxic], 1).astype(float)
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    warm = max(2, epochs // 8)
    for epoch in range(epochs):
        if epoch < warm:  # windows of WARM words at random places
            length = np.minimum(sizes, WARM)
            first = np.cumsum(sizes) - sizes + (rng.random(len(sizes)) * (sizes - length + 1)).astype(np.int64)
        else:
            margin = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
            per_word = np.add.reduceat(margin[bucket], heads[:-1]) / np.diff(heads)
            _, first, length = windows(per_word[flat], sizes)
        # the chosen windows' words, their n-grams, and the share of each n-gram in its window's mean
        text = np.repeat(np.arange(len(texts)), length)
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length)
        word = flat[place]
        n = (heads[1:] - heads[:-1])[word]
        gram = np.repeat(heads[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        g_bucket, g_text = bucket[gram], np.repeat(text, n)
        share = np.repeat(1.0 / (n * length[text]), n)
        order = np.argsort(g_bucket, kind="stable")
        g_bucket, g_text, share = g_bucket[order], g_text[order], share[order]
        cuts = np.flatnonzero(np.concatenate([[True], g_bucket[1:] != g_bucket[:-1]])) if len(g_bucket) else np.zeros(0, np.int64)
        mean = np.stack([np.bincount(g_text, share * vectors[g_bucket, d], len(texts)) for d in range(DIMENSIONS)], 1)
        logits = mean @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - truth) * weight[:, None]
        back = error @ softmax.T
        used = g_bucket[cuts]
        step = np.stack([np.add.reduceat(share * back[g_text, d], cuts) for d in range(DIMENSIONS)], 1) if len(cuts) else np.zeros((0, DIMENSIONS))
        for value, memory, g, at in ((vectors, seen, step, used), (softmax, seen_softmax, mean.T @ error, slice(None)), (bias, seen_bias, error.sum(0), slice(None))):
            memory[at] += g * g
            value[at] -= rate * g / np.sqrt(memory[at])
    return Model((vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores of text columns; the scores of words seen so far are remembered up to max_words."""

    def __init__(self, model: Model, max_words: int = 400_000):
        self.model, self.max_words = model, max_words
        self._forget()

    def _forget(self) -> None:
        self.known, self.values = bytewords.Known(), np.zeros(0)

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = bytewords.text_bytes(column)
        starts, ends, sizes = bytewords.spans(data, offsets, bytewords.GAPS)
        keys, place, inverse = bytewords.distinct(bytewords.keys(data, starts, ends))
        if self.known.n + len(keys) > self.max_words:
            self._forget()
        number = self.known.find(keys)
        fresh = np.flatnonzero(number < 0)
        raw = data.tobytes() if len(fresh) else b""
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            self.values = np.append(self.values, self.model.word_scores([raw[starts[i] : ends[i]].decode() for i in place[some]]))
            self.known.add(keys[some])
        number[fresh] = self.known.find(keys[fresh])
        return windows(self.values[number[inverse]], sizes, self.model.width)[0] + self.model.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(column), -500, 500)))


@lru_cache(maxsize=1)
def scorer_of(key: int, holder) -> Scorer:
    return Scorer(holder.value)


def held_out(doc_id):
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1. Null ids are none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on labelled rows that are not held out: those of each class with the least id hashes, `rows` of each at most.

    Of several texts of a doc_id the least stands for it; a null text is empty;
    labels other than 0 and 1, and rows without a doc_id, teach nothing. Without
    rows of both classes the model gives one score to all texts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for toxic in (0, 1):
        some = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.union(some)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, toxic int")  # 2 * rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    got = sorted((r.doc_id, r.toxic, r.text) for r in one.collect())
    return train([t for _, _, t in got], np.array([y for _, y, _ in got], np.int64))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores (0 to 1) by that name, which replaces one that has it.

    Null and empty texts score as a window without words. Other columns stay, rows
    repeat as often as in docs, and an empty table stays empty. The result is not
    run here: its Arrow batches are as large as the session lets them be.
    """
    spark = docs.sparkSession
    holder = spark.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers
    key = holder._jbroadcast.id() if hasattr(holder, "_jbroadcast") else id(holder)

    @F.pandas_udf("double")
    def toxic_score(text):
        import pandas as pd

        column, scorer = pa.array(text, pa.string()), scorer_of(key, holder)
        out = [scorer.scores(column.slice(lo, hi - lo)) for lo, hi in bytewords.parts(column)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, toxic_score(F.col("text").cast("string")))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text and any other columns) less the rows that score threshold or more; equal texts share a verdict, and null ones are empty."""
    name = common.fresh(docs, "toxic_score")[0]
    keys = dict(zip(("k1", "k2"), common.text_keys()))
    bad = score(docs.select("text", *keys.values()), model, name).where(F.col(name) >= threshold)
    return common.without(docs, bad, keys)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
    with common.small_batches(spark):
        return common.stored(scored, "scores")
