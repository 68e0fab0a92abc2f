"""Every signal query against its SQL in DuckDB, over whole tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tonespark import queries
from tonespark.functions.windows import window
from tonespark.operators import pointwise, spectral
from tonespark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    table = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(table.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r) for r in table.select(", ".join(columns)).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


#: Queries over events that once read the first 512 or 600 samples of a channel; stft_frame gives one slice near the start.
WHOLE = "stft istft spectrogram_magnitude welch welch_median csd csd_density coherence transfer_function transfer_gain_db select_pair hpss_harmonic hpss_percussive noct_spectrum cepstrogram sound_level_z sound_level_db first_order_filter".split()


@pytest.fixture(scope="module")
def two_ends(spark, tmp_path_factory):
    """Two tables of events whose channels are 800 to 840 samples long and differ past sample 600 alone."""
    rng = np.random.default_rng(3)
    rows = [(c, i, float(v)) for c, n in (("click", 800), ("view", 840), ("error", 821)) for i, v in enumerate(rng.normal(20, 5, n))]
    out = []
    for name, add in (("a", 0.0), ("b", 9.0)):
        pdf = pd.DataFrame([(c, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), i, v + (add if i >= 600 and i % 3 else 0.0)) for c, i, v in rows], columns=["event_type", "ts", "event_id", "value"])
        out.append(str(tmp_path_factory.mktemp(name)))
        spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{out[-1]}/events.parquet")
    return out


@pytest.mark.parametrize("name", WHOLE)
def test_late_samples_count(spark, two_ends, name):
    a, b = (sorted(map(tuple, QUERIES[name](spark, d).collect()), key=repr) for d in two_ends)
    assert len(a) == len(b) and a != b
    if name in ("istft", "hpss_harmonic", "hpss_percussive", "sound_level_z", "sound_level_db", "first_order_filter"):
        assert len(a) == 800 + 840 + 821


def test_short_time_spectra_of_unequal_channels(spark, two_ends):
    s = queries.events(spark, two_ends[0])
    values = {c: g.sort_values("sample_idx")["value"].to_numpy() for c, g in s.toPandas().groupby("channel_id")}
    got = spectral.stft(s, None, 64, 16).toPandas()
    ceps = QUERIES["cepstrogram"](spark, two_ends[0]).toPandas()
    w = window("hann", 64)
    for c, x in values.items():
        low, high = spectral.stft_span(len(x), w, 16)
        z, q = (t[t["channel_id"] == c].sort_values(["frame_idx", k]) for t, k in ((got, "freq_idx"), (ceps, "quef_idx")))
        assert len(z) == (high - low) * 33
        z, q = (z["re"] + 1j * z["im"]).to_numpy().reshape(-1, 33), q["value"].to_numpy().reshape(-1, 64)
        wide = np.pad(x, 4 * 64)
        for p in range(low, high):
            at = p * 16 - 32 + 4 * 64
            want = np.fft.rfft(np.roll(wide[at : at + 64] * w, -32)) * spectral.one_sided(64) / w.sum()
            assert np.allclose(z[p - low], want, atol=1e-9)
            assert np.allclose(q[p - low], np.fft.irfft(np.log(np.maximum(abs(want), 1e-12)), 64), atol=2e-5)


def test_pairs_take_the_common_length(spark, two_ends):
    got = QUERIES["coherence"](spark, two_ends[0]).toPandas()
    assert (got["value"] <= 1 + 1e-6).all()
    assert pointwise.common_length(queries.events(spark, two_ends[0])).groupBy("channel_id").count().toPandas()["count"].tolist() == [800] * 3


@pytest.mark.parametrize("name", "arith_reverse_add arith_reverse_sub arith_reverse_mul arith_reverse_div arith_reverse_pow normalize_inf normalize_neg_inf normalize_l0 normalize_l1 normalize_l2".split())
def test_every_row_counts(spark, con, name):
    assert QUERIES[name](spark, SF).count() == con.sql("SELECT count(*) FROM events").fetchall()[0][0]


def test_division_by_zero(spark):
    s = spark.createDataFrame([("r", "c", i, v) for i, v in enumerate((0.0, 4.0))], "frame_id string, channel_id string, sample_idx long, value double")
    assert [r.value for r in pointwise.with_scalar(s, "div", 2.0, reverse=True).orderBy("sample_idx").collect()] == [float("inf"), 0.5]


@pytest.mark.parametrize("name", ["arith_reverse_div", "arith_frames_div", "arith_div"])
def test_division_of_odd_values(spark, tmp_path, name):
    """Nulls, zeros of both signs and what is not finite, as SQL divides them."""
    con = duckdb.connect()
    values = ["NULL", "0.0", "'-0.0'", "4.0", "'nan'", "'inf'", "'-inf'", "1e-310", "-1e-200"]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 00:00:0{i}', 'click', {v}::DOUBLE)" for i, v in enumerate(values))
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, event_type, value)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    got = [(r.sample_idx, str(r.value)) for r in QUERIES[name](spark, str(tmp_path)).orderBy("sample_idx").collect()]
    assert got == [(i, str(v)) for i, v in con.sql(f"SELECT sample_idx, value FROM ({ORACLES[name]}) ORDER BY 1").fetchall()] and len(got) == len(values)


def test_division_of_signed_zeros(spark):
    zeros = [(n, z) for n in (2.0, -2.0, 0.0, float("nan"), None) for z in (0.0, -0.0, None)]
    df = spark.createDataFrame([(i, n, z) for i, (n, z) in enumerate(zeros)], "i long, n double, z double")
    got = [str(r.q) for r in df.select("i", pointwise.OPERATIONS["div"](df.n, df.z).alias("q")).orderBy("i").collect()]
    assert got == ["inf", "-inf", "None", "-inf", "inf", "None", *["nan", "nan", "None"] * 2, *["None"] * 3]
