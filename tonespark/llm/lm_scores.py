"""Cross-entropy difference of matched n-gram language models.

Two bigram models over one vocabulary, that of a public tokenizer, differ only
in what they count: documents of the target, or all documents. Both are
smoothed alike. A document's score is its loss a token under the target's model
less that under the background's: the lower, the more it is like the target. A
document is judged by what the others hold: its own counts are left out.

All bigrams of all documents are counted, so the models grow with the corpus and
no executor holds one whole. Documents are taken in chunks; a chunk sends its
distinct bigrams with their counts, each bigram's counts are summed over chunks
(partly before they are shuffled), and a chunk gets back the sums of its own
bigrams by a join whose sides stand alone, so that a bigram of all chunks can be
split among tasks. Only what the vocabulary
bounds, the counts of single tokens, is sent to all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytewords, common
from .encoding import encoder, public_path

#: Tokens of a chunk: what one group holds in memory. A longer document is a chunk of its own.
CHUNK_TOKENS = 2_400_000
#: Tokens that are scored at a time.
SLICE_TOKENS = 200_000
#: Smoothing: a bigram's estimate counts MASS tokens of the single-token estimate, and that counts ADD of each token.
MASS, ADD = 20.0, 0.5
#: Target ids that are sent to every executor at most; more are joined by shuffling.
BROADCAST_ROWS = 1_000_000
CHUNK = "chunk long, key long, target int, background int, doc_ids binary, has_id binary, is_target binary, lengths binary, ids binary"


def bigrams(ids: np.ndarray, lengths: np.ndarray, vocab: int) -> np.ndarray:
    """previous * (vocab + 1) + token for each token; the token before a document's first is `vocab`."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    heads = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[heads] = vocab
    return before * (vocab + 1) + ids


def chunks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text, is_target) as chunks: a row with its ids, and a row for each of its distinct bigrams with counts in target documents and in all."""

    def rows(batch_iter):
        coder, task, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal number
            ids, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc_ids, target = [d for h in held for d in h[2]], np.concatenate([h[3] for h in held])
            chunk = (task << 24) + number
            number += 1
            key, inverse = np.unique(bigrams(ids, lengths, coder.vocab_size), return_inverse=True)
            n = len(key)
            counts = [np.bincount(inverse, minlength=n).astype(np.int32)]
            counts.insert(0, np.bincount(inverse[np.repeat(target, lengths)], minlength=n).astype(np.int32))
            none = pa.nulls(n, pa.binary())
            names = [c.split()[0] for c in CHUNK.split(", ")]
            for at in range(0, n, 50_000):
                part = slice(at, min(at + 50_000, n))
                size = part.stop - at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, chunk)), pa.array(key[part]), pa.array(counts[0][part]), pa.array(counts[1][part]), *[none.slice(0, size)] * 5], names)
            blob = [
                np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), target.astype(np.uint8).tobytes(), lengths.astype(np.int64).tobytes(), ids.astype(np.uint32 if coder.vocab_size > 1 << 16 else np.uint16).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), *(pa.array([b], pa.binary()) for b in blob)], names)

        for batch in batch_iter:
            column, doc_ids, target = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("is_target").to_numpy(zero_copy_only=False)
            for lo, hi in bytewords.parts(column):
                ids, lengths = coder.encode(column.slice(lo, hi - lo))
                if held and tokens + len(ids) > CHUNK_TOKENS:
                    yield from flush()
                    held, tokens = [], 0
                held.append((ids, lengths, doc_ids[lo:hi], target[lo:hi].astype(bool)))
                tokens += len(ids)
        if held:
            yield from flush()
            held = []
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "is_target").mapInArrow(rows, CHUNK)


def single_counts(grams: DataFrame, vocab: int) -> np.ndarray:
    """(4, vocab + 1): counts of each token, and of each token as the one before, in the target and in all; bounded by the vocabulary."""
    out = np.zeros((4, vocab + 1))
    width = F.lit(vocab + 1)
    for row, part in ((0, (F.col("key") % width)), (2, F.floor(F.col("key") / width))):
        for token, target, background in grams.groupBy(part.cast("int").alias("token")).agg(F.sum("target"), F.sum("background")).collect():
            out[row, token], out[row + 1, token] = target, background
    return out


def log_chances(pair, token, context, total, vocab: int) -> np.ndarray:
    """Log chance of tokens from the counts of the pair, of the token, of the token before it as a context, and of all tokens."""
    return np.log((pair + MASS * (token + ADD) / (total + ADD * vocab)) / (context + MASS))


def own_counts(owner: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """For each token how often its document has its value (0 to most)."""
    _, which, count = np.unique(owner * (most + 1) + value, return_inverse=True, return_counts=True)
    return count[which]


def score(docs: DataFrame, target_ids: DataFrame, tokenizer: str | None = None, leave_one_out: bool = True) -> DataFrame:
    """Score docs (doc_id, text) against those of them that target_ids (doc_id) names.

    Result, a row for each row of docs: doc_id, n_tokens, target_loss and
    background_loss (nats a token), difference (the first less the second). With
    leave_one_out a row's own counts are taken out of both models before it is
    scored. Texts without tokens (null, empty) have losses of 0. Repeated rows
    count and score as often as they come, so each is scored by the others; rows
    without doc_id are never targets; an empty table gives no rows; other columns
    are ignored. The result is stored.
    """
    spark, path = docs.sparkSession, tokenizer or public_path("word_bpe_49k.json")
    with common.Scratch(spark, "lm") as scratch, common.small_batches(spark):
        return common.stored(_score(docs, target_ids, path, leave_one_out, scratch), "losses")


def _score(docs: DataFrame, target_ids: DataFrame, path: str, leave_one_out: bool, scratch: common.Scratch) -> DataFrame:
    spark, vocab = docs.sparkSession, encoder(path).vocab_size
    wanted = scratch.store(target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("_t", F.lit(True)), "targets")
    small = wanted.count() <= BROADCAST_ROWS
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if small else wanted, "doc_id", "left").select("doc_id", "text", F.coalesce("_t", F.lit(False)).alias("is_target"))
    table = scratch.store(chunks(marked, path), "chunks")
    grams = table.where("key IS NOT NULL").select("chunk", "key", "target", "background")
    sums = scratch.store(grams.groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "sums")
    singles = spark.sparkContext.broadcast(single_counts(sums, vocab))
    met = grams.select(F.col("chunk").alias("owner"), "key").join(sums, "key").select("owner", "key", "target", "background")
    blobs = table.where("key IS NULL").select("chunk", "doc_ids", "has_id", "is_target", "lengths", "ids")

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right.column("key").to_numpy()
        order = np.argsort(key)
        key, counts = key[order], [right.column(c).to_numpy()[order] for c in ("target", "background")]
        out = [part for row in range(left.num_rows) for part in chunk_losses({c: left.column(c)[row].as_buffer() for c in left.column_names if c != "chunk"}, key, counts, singles.value)]
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "target_loss": pa.array([], pa.float64()), "background_loss": pa.array([], pa.float64()), "difference": pa.array([], pa.float64())})

    def chunk_losses(blob: dict, key: np.ndarray, counts: list, tables: np.ndarray):
        lengths, target = np.frombuffer(blob["lengths"], np.int64), np.frombuffer(blob["is_target"], np.uint8)
        every = np.frombuffer(blob["ids"], np.uint32 if vocab > 1 << 16 else np.uint16)
        numbers = pa.array(np.frombuffer(blob["doc_ids"], np.int64), mask=np.frombuffer(blob["has_id"], np.uint8) == 0)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < len(lengths):  # whole documents, SLICE_TOKENS at a time
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_TOKENS, side="right")) - 1)
            size = lengths[at:end]
            pair = bigrams(every[starts[at] : starts[end]].astype(np.int64), size, vocab)
            before, token = pair // (vocab + 1), pair % (vocab + 1)
            place, owner = np.searchsorted(key, pair), np.repeat(np.arange(len(size)), size)
            own = [own_counts(owner, x, most) for x, most in ((place, len(key)), (token, vocab), (before, vocab))] if leave_one_out and len(pair) else [0, 0, 0]
            loss = []
            for i in (0, 1):
                mine = np.repeat(target[at:end], size) if i == 0 else 1  # the background has every document
                total = tables[i].sum() - (np.repeat(size, size) * mine if leave_one_out else 0)
                chance = log_chances(counts[i][place] - own[0] * mine, tables[i][token] - own[1] * mine, tables[i + 2][before] - own[2] * mine, total, vocab)
                loss.append(-np.bincount(owner, chance, len(size)) / np.maximum(size, 1))
            yield pa.table({"doc_id": numbers.slice(at, end - at), "n_tokens": size, "target_loss": loss[0], "background_loss": loss[1], "difference": loss[0] - loss[1]})
            at = end

    return blobs.groupBy("chunk").cogroup(met.groupBy("owner")).applyInArrow(losses, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return score(common.documents(spark, sf_dir, "doc_id", "text"), good)
