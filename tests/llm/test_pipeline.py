import collections

import numpy as np
import pytest

import corpus_pipeline
from tonespark.llm import common, jaccard_join, mixing, packing, quality, toxicity

from .conftest import ODD, SF
from .test_operators import brute_join


def test_stages(spark, docs):
    """Each stage keeps what its operator says of the stage's own input."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    at = common.stored(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    assert {r.doc_id for r in at.collect()} == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
    verdicts = {r.doc_id for r in quality.quality(at).where("kept").collect()}
    at = common.stored(corpus_pipeline.drop_bad(spark, at, SF), "t")
    assert {r.doc_id for r in at.collect()} == verdicts
    classes = brute_join([(r.doc_id, r.text) for r in at.collect()])
    at = common.stored(corpus_pipeline.drop_near_copies(spark, at, SF), "t")
    assert sorted(r.doc_id for r in at.collect()) == sorted(d for d, (c, _) in classes.items() if c == d)
    taken = {r.doc_id: r.taken / r.size for r in mixing.mix(at).collect() if r.size}
    at = common.stored(corpus_pipeline.mix_sources(spark, at, SF), "t")
    assert at.columns == docs.columns
    times = collections.Counter(r.doc_id for r in at.collect())
    assert times == {d: round(x + 1e-12) for d, x in taken.items() if x >= 0.5}
    last = corpus_pipeline.pack_sequences(spark, at, SF).collect()
    assert collections.Counter(r.doc_id for r in last if r.piece == 0) == times
    assert max(np.bincount([r.sequence_id for r in last], [r.length for r in last])) <= packing.CAPACITY


@pytest.mark.parametrize("table", ["odd", "clashing"])
def test_odd_rows_pass(request, spark, table):
    at = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = common.stored(stage(spark, at, SF), "t")
        assert name == "best-fit packing" or at.columns == before.columns
    assert len(ODD) >= at.count() >= 0


def test_nothing_passes(spark, none):
    at = none
    for _, stage in corpus_pipeline.STAGES:
        at = common.stored(stage(spark, at, SF), "t")
    assert at.count() == 0


def test_join_is_used(spark):
    assert jaccard_join.THRESHOLD == 0.8 and jaccard_join.WORDS == 5
