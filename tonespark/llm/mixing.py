"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in an order shuffled by the md5 of their ids, are one
stream of words cut into equal blocks. A schedule of slots says whose block
comes next: slot t's van der Corput point is mapped through the sources'
cumulative shares, so every prefix of the schedule is near the target weights.
A source's r-th slot takes its r-th block, starting over at the stream's end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Weights of sources in the order of their names' code points, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1024
#: Slots that are ranked together.
CHUNK = 4096
#: Cells of the unit interval in which a slot meets its source's interval.
CELLS = 4096


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words that each source gives: source, source_no, source_size, target (double) and words (target as a whole number).

    sizes has a row per document: source, size. The sources share `share` of all
    words by weight; one never gives more than `most` times its words, and what it
    leaves goes to the others by weight. With the sources ordered by cap / weight,
    those before some place are capped and the others share the rest; the level
    of that sharing rises with each source that it would pass, and falls after
    them, so it settles at the largest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # a row per source
    numbered = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int") + 1)
    capped = numbered.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = W.orderBy("_ratio", "source_no")
    before, all_rows = every.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    leveled = capped.withColumn("_level", level).withColumn("_met", F.max("_level").over(all_rows))
    target = F.least(F.col("_cap"), F.col("_w") * F.col("_met"))
    return leveled.select("source", "source_no", "source_size", target.alias("target")).withColumn("words", F.round("target").cast("long"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: slot, source_no, rank (of the slot in its source), block, take (words of the block that it takes).

    Shares are whole numbers of slots. The points of as many slots leave a source
    at most a few slots over or short of its share (their discrepancy); slots over
    it are void, and what a source lacks follows at the end.
    """
    spark = sources.sparkSession
    plan = sources.where("words > 0").withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("long"))
    passes = F.floor(F.col("words") / F.col("source_size"))
    rest = F.col("words") - passes * F.col("source_size")
    plan = plan.withColumn("slots", (passes * F.col("blocks") + F.ceil(rest / F.lit(float(block_words)))).cast("long"))
    plan = plan.withColumn("to", F.sum("slots").over(W.orderBy("source_no"))).withColumn("from", F.col("to") - F.col("slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, int(total - 1).bit_length()) if total else 1
    # the van der Corput point of t is t's bits reversed; at x = point * total it falls into one source's [from, to)
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("_x", F.floor(point * F.lit(float(total))).cast("long"))
    cell = lambda x: F.floor(x * F.lit(float(CELLS)) / F.lit(float(max(total, 1)))).cast("int")
    wide = plan.withColumn("_cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to") - 1))))
    met = slots.withColumn("_cell", cell(F.col("_x"))).join(wide.select("_cell", "from", "to", "source_no"), "_cell").where("_x >= from AND _x < to")
    chunked = met.select("slot", "source_no", F.floor(F.col("slot") / F.lit(CHUNK)).cast("long").alias("_chunk"), F.lit(1).alias("_one"))
    ranked = common.running_sums(chunked, "source_no", "_chunk", ["slot"], "_one", "_sum", "rank").select("slot", "source_no", "rank")
    ranked = common.stored(ranked.join(plan.select("source_no", "slots"), "source_no").where("rank < slots").drop("slots"), "slots", few=True)
    have = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("_have"))
    short = plan.join(have, "source_no", "left").select("source_no", "slots", F.coalesce("_have", F.lit(0)).alias("_have")).where("_have < slots")
    tail = short.select("source_no", F.explode(F.sequence("_have", F.col("slots") - 1)).alias("rank"))
    tail = tail.select((F.lit(total) + F.row_number().over(W.orderBy("rank", "source_no")) - 1).cast("long").alias("slot"), "source_no", "rank")
    both = ranked.unionByName(tail).join(plan.select("source_no", "source_size", "words", "blocks"), "source_no")
    round_no, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    begin = block * block_words
    full = F.least(F.lit(block_words).cast("long"), F.col("source_size") - begin)
    left = F.col("words") - round_no * F.col("source_size") - begin
    return both.select("slot", "source_no", "rank", block.alias("block"), F.greatest(F.lit(0), F.least(full, left)).cast("long").alias("take"))


def streams(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Place of each document in its source's shuffled stream: doc_id, size, source_no, start, place (number in the stream)."""
    n = sizes.count()
    k = common.buckets_for(n)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shuffled = sizes.withColumn("_key", key).withColumn("_bucket", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * F.lit(float(k)) / F.lit(float(1 << 32))).cast("long"))
    named = shuffled.join(F.broadcast(sources.select("source", "source_no")) if sources.count() <= 10_000 else sources.select("source", "source_no"), shuffled["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    return common.running_sums(named.select("doc_id", "size", "source_no", "_bucket", "_key"), "source_no", "_bucket", ["_key", "doc_id", "size"], "size", "start", "place").select(
        "doc_id", "size", "source_no", "start", "place"
    )


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words that the mix takes of each row of docs (doc_id, text, source).

    Result: doc_id, source, size (words of the text, 0 for null), source_size,
    target (of its source), taken. Rows repeat as often as in docs; rows without
    words are taken 0 words of; a null source is a source of its own, the last; an
    empty table gives no rows; other columns of docs are ignored. Null doc_ids
    shuffle like an empty id.
    """
    sizes = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), common.word_count(F.col("text").cast("string")).alias("size")), "sizes")
    sources = common.stored(targets(sizes, weights, share, most), "sources")
    placed = common.stored(streams(sizes, sources), "streams", few=True)
    block = F.lit(block_words)
    parts = placed.where("size > 0").select(
        "source_no", "place", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    )
    slots = schedule(sources, block_words).select("source_no", "block", "take")
    # of a block the slot takes its first `take` words: how many of them are this document's
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, block)
    words = F.greatest(F.lit(0), F.least(high, F.col("take")) - low)
    taken = parts.join(slots, ["source_no", "block"]).groupBy("source_no", "place").agg(F.sum(words).cast("long").alias("taken"))
    all_docs = placed.join(taken, ["source_no", "place"], "left")
    few = sources.select("source_no", "source", "source_size", "target")
    return all_docs.join(few, "source_no").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def take(docs: DataFrame, **options) -> DataFrame:
    """docs as often as the mix takes them: once for every pass that takes half of a document's words or more.

    Documents without words (null, empty) go. Rows are told by doc_id, source and
    size: of several that are equal in these, each comes as often as they are taken
    on the average. A null source or doc_id equals another; the columns of docs
    stay; an empty table stays empty.
    """
    mixed = mix(docs, **options).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("copies")).where("copies > 0")
    names = common.fresh(docs, "mix_id", "mix_source", "mix_size", "mix_copies")
    mixed = mixed.toDF(*names)
    size = common.word_count(F.col("text").cast("string"))
    on = docs["doc_id"].cast("long").eqNullSafe(mixed[names[0]]) & docs["source"].cast("string").eqNullSafe(mixed[names[1]]) & (size == mixed[names[2]])
    both = docs.join(mixed, on)
    return both.withColumn(names[3], F.explode(F.sequence(F.lit(1), names[3]))).select(*docs.columns)


def op2_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir, "doc_id", "text", "source")).drop("source")


#: The same words by arithmetic: of a source's shuffled stream, whole passes and then a prefix are taken.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST(no % 3 + 1 AS INT)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(level) OVER () AS met FROM l),
t AS (SELECT source, source_size, least(cap, weight * met) AS target, CAST(round(least(cap, weight * met)) AS BIGINT) AS words FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.words,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken
FROM p
"""
