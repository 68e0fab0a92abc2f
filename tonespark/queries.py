"""Queries over signals derived from the driver's tables, each with the same thing in SQL where SQL can say it.

Signals: events (a channel for each event type, samples in order of time), emb
(a channel of 64 samples for each vector), li (a channel for each return flag).
All have a nominal rate of 64 Hz.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import levels
from .functions.kernels import butterworth, butterworth_sections, extension, polyphase, weighting_sections
from .functions.tables import KEY, number_rows
from .functions.windows import tukey, window
from .frame import Channel, Header
from .operators import filters, loudness, pointwise, spectral, stats, windowed
from .signal import Signal

RATE = 64.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", "value")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    return number_rows(rows, ["event_type"], hour, ["ts", "event_id"], "sample_idx").select(F.lit("events").alias("frame_id"), F.col("event_type").alias("channel_id"), "sample_idx", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("emb").alias("frame_id"), F.col("vec_id").cast("string").alias("channel_id"), F.posexplode("embedding").alias("_i", "_v"))
    return rows.select(*KEY, F.col("_i").cast("long").alias("sample_idx"), F.col("_v").cast("double").alias("value"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", *order)
    numbered = number_rows(rows, ["l_returnflag"], F.floor(F.col("l_orderkey") / 1024), order, "sample_idx")
    return numbered.select(F.lit("li").alias("frame_id"), F.col("l_returnflag").alias("channel_id"), "sample_idx", F.col("l_quantity").alias("value"))


def as_signal(df: DataFrame, rate: float = RATE) -> Signal:
    """A signal of a table whose channels are labelled by their ids."""
    ids = sorted(r[0] for r in df.select("channel_id").distinct().collect())
    return Signal(df, Header("time", rate, tuple(Channel(i, i) for i in ids)))


EV = "ev AS (SELECT 'events' AS frame_id, event_type AS channel_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sample_idx, value FROM events)"
EMB = "emb AS (SELECT 'emb' AS frame_id, CAST(vec_id AS VARCHAR) AS channel_id, t.i - 1 AS sample_idx, CAST(embedding[t.i] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(i))"
LI = "li AS (SELECT 'li' AS frame_id, l_returnflag AS channel_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS sample_idx, l_quantity AS value FROM lineitem)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def rounded_sql(body: str, doubles: str, longs: str, strings: str, places: int = 6) -> str:
    cols = [f"round({c}, {places}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + strings.split()
    return f"{body} SELECT {', '.join(cols)} FROM result"


def query(name: str, sql: str | None = None, doubles: str = "value", longs: str = "sample_idx", strings: str = "frame_id channel_id", places: int = 6):
    """Register a query; sql is a WITH clause that ends in a table named result."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLES[name] = rounded_sql(sql, doubles, longs, strings, places)
        return f

    return register


def sample_query(name: str, source, cte: str, plan, select: str):
    """A query from samples to samples: `select` gives the same rows from the source's table s."""
    table = cte.split(" ", 1)[0]
    query(name, f"WITH {cte}, s AS (SELECT * FROM {table}), {select}" if select.lstrip().startswith(("result", "a AS", "f AS")) else f"WITH {cte}, s AS (SELECT * FROM {table}), result AS ({select})")(
        lambda spark, sf_dir: plan(source(spark, sf_dir))
    )


ROW = "frame_id, channel_id, sample_idx"
sample_query("scan_signal", events, EV, lambda s: s, "SELECT * FROM s")
sample_query("scan_vectors", vectors, EMB, lambda s: s, "SELECT * FROM s")
sample_query("scan_lineitem", items, LI, lambda s: s, "SELECT * FROM s")
sample_query("channel_select", events, EV, lambda s: pointwise.select_channels(s, ["click", "view"]), "SELECT * FROM s WHERE channel_id IN ('click', 'view')")
sample_query("remove_channel", events, EV, lambda s: pointwise.remove_channels(s, ["click"]), "SELECT * FROM s WHERE channel_id <> 'click'")
sample_query("query_regex", events, EV, lambda s: as_signal(s).get_channel(re.compile("^[a-l]")).df, "SELECT * FROM s WHERE regexp_matches(channel_id, '^[a-l]')")
sample_query("trim", events, EV, lambda s: pointwise.trim(s, int(1.5 * RATE), int(6.25 * RATE)), "SELECT frame_id, channel_id, sample_idx - 96 AS sample_idx, value FROM s WHERE sample_idx >= 96 AND sample_idx < 400")
sample_query(
    "fix_length_cut", events, EV, lambda s: pointwise.fix_length(s, 100), "SELECT * FROM s WHERE sample_idx < 100"
)
sample_query(
    "fix_length_pad", vectors, EMB, lambda s: pointwise.fix_length(s, 80),
    "SELECT * FROM s UNION ALL SELECT frame_id, channel_id, r.i, 0.0 FROM (SELECT DISTINCT frame_id, channel_id FROM s), range(64, 80) r(i)",
)
sample_query("calibrate", events, EV, lambda s: pointwise.scale(s, {"click": 2.5, "view": 0.1}), f"SELECT {ROW}, value * CASE channel_id WHEN 'click' THEN 2.5::DOUBLE WHEN 'view' THEN 0.1::DOUBLE ELSE 1.0 END AS value FROM s")
for _op, _sql in (("add", "value + 1.5"), ("sub", "value - 1.5"), ("mul", "value * 1.5"), ("div", "value / 1.5"), ("pow", "pow(value, 1.5)")):
    sample_query(f"arith_{_op}", events, EV, lambda s, op=_op: pointwise.with_scalar(pointwise.absolute(s), op, 1.5), f"SELECT {ROW}, {_sql.replace('value', 'abs(value)')} AS value FROM s")
for _op, _sql in (("add", "2.0 + value"), ("sub", "2.0 - value"), ("mul", "2.0 * value"), ("div", "2.0 / value")):
    sample_query(f"arith_reverse_{_op}", events, EV, lambda s, op=_op: pointwise.with_scalar(s, op, 2.0, reverse=True), f"SELECT {ROW}, {_sql.replace('2.0', '2.0::DOUBLE')} AS value FROM s")
# powers reach 1e168, where engines differ in the last bit: digits and exponent
query(
    "arith_reverse_pow",
    f"WITH {EV}, p AS (SELECT {ROW}, pow(2.0::DOUBLE, value) AS value FROM ev), e AS (SELECT *, floor(log10(value)) AS exponent FROM p), result AS (SELECT {ROW}, exponent, value / pow(10.0::DOUBLE, exponent) AS digits FROM e)",
    "digits", "sample_idx exponent",
)(
    lambda spark, sf_dir: pointwise.with_scalar(events(spark, sf_dir), "pow", 2.0, reverse=True)
    .withColumn("exponent", F.floor(F.log10("value"))).select(*KEY, "sample_idx", "exponent", (F.col("value") / F.pow(F.lit(10.0), F.col("exponent"))).alias("digits"))
)
for _op, _sql in (("add", "s.value + o.value"), ("sub", "s.value - o.value"), ("mul", "s.value * o.value"), ("div", "s.value / o.value")):
    sample_query(
        f"arith_frames_{_op}", events, EV, lambda s, op=_op: pointwise.with_signal(s, pointwise.with_scalar(pointwise.absolute(s), "add", 3.0), op),
        f"SELECT s.frame_id, s.channel_id, s.sample_idx, {_sql} AS value FROM s JOIN (SELECT {ROW}, abs(value) + 3.0 AS value FROM s) o USING (frame_id, channel_id, sample_idx)",
    )
sample_query("abs", events, EV, pointwise.absolute, f"SELECT {ROW}, abs(value) AS value FROM s")
sample_query("power", events, EV, lambda s: pointwise.power(s, 2.0), f"SELECT {ROW}, value * value AS value FROM s")
sample_query(
    "channel_difference", events, EV, lambda s: pointwise.difference(s, "click"),
    "SELECT s.frame_id, s.channel_id, s.sample_idx, s.value - o.value AS value FROM s JOIN s o ON o.channel_id = 'click' AND o.frame_id = s.frame_id AND o.sample_idx = s.sample_idx",
)
sample_query(
    "concat_frame", events, EV, lambda s: pointwise.concat(s, pointwise.select_channels(s, ["click"]), {"click": "click_2"}),
    "SELECT * FROM s UNION ALL SELECT frame_id, 'click_2', sample_idx, value FROM s WHERE channel_id = 'click'",
)
sample_query(
    "mix_pad", events, EV, lambda s: pointwise.mix(s, pointwise.trim(pointwise.select_channels(s, ["view"]), 0, 150), one_channel=True),
    "SELECT s.frame_id, s.channel_id, s.sample_idx, s.value + coalesce(o.value, 0) AS value FROM s LEFT JOIN s o ON o.channel_id = 'view' AND o.sample_idx = s.sample_idx AND o.sample_idx < 150",
)
sample_query(
    "mix_snr", events, EV, lambda s: pointwise.mix_snr(s, pointwise.with_scalar(s, "sub", 1.0), 6.0),
    f"""a AS (SELECT frame_id, channel_id, sqrt(avg(value * value)) AS c, sqrt(avg((value - 1) * (value - 1))) AS n FROM s GROUP BY ALL),
    result AS (SELECT s.frame_id, s.channel_id, s.sample_idx, s.value + (s.value - 1) * (c / {10 ** (6 / 20)!r}::DOUBLE / n) AS value FROM s JOIN a USING (frame_id, channel_id))""",
)

BY = "frame_id, channel_id"


def channel_query(name: str, source, cte: str, plan, select: str, doubles: str):
    table = cte.split(" ", 1)[0]
    query(name, f"WITH {cte}, s AS (SELECT * FROM {table}), result AS ({select})", doubles, "")(lambda spark, sf_dir: plan(source(spark, sf_dir)))


channel_query("rms", events, EV, stats.rms, f"SELECT {BY}, sqrt(avg(value * value)) AS rms FROM s GROUP BY ALL", "rms")
channel_query("rms_lineitem", items, LI, stats.rms, f"SELECT {BY}, sqrt(avg(value * value)) AS rms FROM s GROUP BY ALL", "rms")
channel_query("crest_factor", events, EV, stats.crest_factor, f"SELECT {BY}, CASE WHEN sqrt(avg(value * value)) > 0 THEN max(abs(value)) / sqrt(avg(value * value)) ELSE 1.0 END AS crest_factor FROM s GROUP BY ALL", "crest_factor")
sample_query("sum_channels", events, EV, lambda s: stats.across_channels(s, "sum"), "SELECT frame_id, 'sum' AS channel_id, sample_idx, sum(value) AS value FROM s GROUP BY ALL")
sample_query("mean_channels", events, EV, lambda s: stats.across_channels(s, "mean"), "SELECT frame_id, 'mean' AS channel_id, sample_idx, avg(value) AS value FROM s GROUP BY ALL")
sample_query("remove_dc", events, EV, stats.remove_dc, f"SELECT {ROW}, value - avg(value) OVER (PARTITION BY {BY}) AS value FROM s")
_OVER = f"OVER (PARTITION BY {BY})"
for _name, _norm, _sql in (
    ("inf", math.inf, f"max(abs(value)) {_OVER}"), ("neg_inf", -math.inf, f"(CASE WHEN min(abs(value)) {_OVER} > 0 THEN min(abs(value)) {_OVER} ELSE 1.0::DOUBLE END)"), ("l1", 1.0, f"sum(abs(value)) {_OVER}"), ("l2", 2.0, f"sqrt(sum(value * value) {_OVER})"),
    ("l0", 0.0, f"sum(CASE WHEN value <> 0 THEN 1.0 ELSE 0.0 END) {_OVER}"),
):
    sample_query(
        f"normalize_{_name}", events, EV, lambda s, norm=_norm: stats.normalize(s, norm), f"SELECT {ROW}, value / {_sql} AS value FROM s",
    )
sample_query("normalize_frame", events, EV, lambda s: stats.normalize(s, 2.0, whole_frame=True), f"SELECT {ROW}, value / sqrt(sum(value * value) OVER (PARTITION BY frame_id)) AS value FROM s")


@query("derive_calibration", f"WITH {EV}, result AS (SELECT channel_id, 0.5 * 94.0 / sqrt(avg(value * value)) AS factor FROM ev GROUP BY ALL)", "factor", "", "channel_id")
def derive_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.derived_factors(events(spark, sf_dir), {c: 0.5 for c in ("click", "view", "purchase", "login", "logout", "error", "signup", "search")} | _halves(spark, sf_dir), target_rms=94.0)
    return spark.createDataFrame(sorted(got.items()), "channel_id string, factor double")


def _halves(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return {r[0]: 0.5 for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect()}


def _frames_sql(length: int, hop: int, table: str = "s") -> str:
    pad = length // 2
    return f"""n AS (SELECT {BY}, max(sample_idx) + 1 AS n FROM {table} GROUP BY ALL),
    f AS (SELECT {BY}, r.f AS sample_idx FROM n, range(0, 100000) r(f) WHERE r.f <= (n + {2 * pad} - {length}) // {hop}),
    e AS (SELECT {BY}, g.f AS sample_idx, value FROM {table}, range(0, {length // hop + 2}) k(k), LATERAL (SELECT (sample_idx + {pad}) // {hop} - k.k AS f) g
          WHERE g.f >= 0 AND sample_idx + {pad} - g.f * {hop} < {length}),
    r AS (SELECT {BY}, f.sample_idx, sqrt(coalesce(sum(e.value * e.value), 0) / {length}) AS value FROM f LEFT JOIN e USING ({BY}, sample_idx) GROUP BY ALL)"""


query("rms_trend", f"WITH {EV}, a AS (SELECT {ROW}, value - avg(value) OVER (PARTITION BY {BY}) AS value FROM ev), {_frames_sql(64, 16, 'a')}, result AS (SELECT * FROM r)")(
    lambda spark, sf_dir: windowed.rms_trend(stats.remove_dc(events(spark, sf_dir)), 64, 16)
)
query("rms_trend_db", f"WITH {EV}, {_frames_sql(100, 30, 'ev')}, result AS (SELECT {ROW}, 20 * log10(greatest(value / 2e-5::DOUBLE, 1e-12::DOUBLE)) AS value FROM r)")(
    lambda spark, sf_dir: windowed.rms_trend(s := events(spark, sf_dir), 100, 30, True, {r[0]: 2e-5 for r in s.select("channel_id").distinct().collect()})
)
sample_query(
    "fade", events, EV, lambda s: pointwise.fade(s, 20),
    f"""a AS (SELECT *, max(sample_idx) OVER (PARTITION BY {BY}) AS last FROM s), f AS (SELECT *, least(1.0::DOUBLE, 40.0::DOUBLE / (last + 1)) * last / 2 AS ramp, least(sample_idx, last - sample_idx) AS k FROM a),
    result AS (SELECT {ROW}, value * CASE WHEN k < ramp THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * k / ramp) ELSE 1.0 END AS value FROM f)""",
)
query(
    "level_crossings", f"WITH {EV}, a AS (SELECT *, lead(value) OVER (PARTITION BY {BY} ORDER BY sample_idx) AS nxt FROM ev), result AS (SELECT {ROW} FROM a WHERE sign(nxt - 30.0) > sign(value - 30.0))", ""
)(lambda spark, sf_dir: windowed.crossings(events(spark, sf_dir), 30.0))
_TRIGGERS = f"""WITH RECURSIVE {EV}, a AS (SELECT *, lead(value) OVER (PARTITION BY {BY} ORDER BY sample_idx) AS nxt, max(sample_idx) OVER (PARTITION BY {BY}) + 1 AS n FROM ev),
    c AS (SELECT {ROW} FROM a WHERE sign(nxt - 30.0) > sign(value - 30.0) AND sample_idx + 25 < n),
    h AS (SELECT {BY}, min(sample_idx) AS p FROM c GROUP BY ALL UNION ALL
          SELECT h.frame_id, h.channel_id, (SELECT min(c.sample_idx) FROM c WHERE c.channel_id = h.channel_id AND c.sample_idx > h.p + 25) FROM h WHERE h.p IS NOT NULL),
    t AS (SELECT {BY}, p + 2 AS point FROM h WHERE p IS NOT NULL)"""
query("level_trigger", f"{_TRIGGERS}, result AS (SELECT * FROM t)", "", "point")(lambda spark, sf_dir: windowed.level_trigger(events(spark, sf_dir), 30.0, 2, 25))
_TUKEY = ", ".join(repr(float(x)) for x in tukey(32, 0.5))
# means of 32 samples have seven decimals: rounded to eight, none lies at a half
query(
    "cut_sig",
    f"""{_TRIGGERS}, n AS (SELECT {BY}, max(sample_idx) + 1 AS n FROM ev GROUP BY ALL),
    p AS (SELECT t.* FROM t JOIN n USING ({BY}) WHERE point + 32 <= n),
    g AS (SELECT p.frame_id, p.channel_id, point, sample_idx - point AS place, value FROM p JOIN ev ON ev.channel_id = p.channel_id AND sample_idx >= point AND sample_idx < point + 32),
    result AS (SELECT {BY}, point, place, (value - avg(value) OVER (PARTITION BY channel_id, point)) * list_extract([{_TUKEY}]::DOUBLE[], CAST(place + 1 AS BIGINT)) AS value FROM g)""",
    "value", "point place", places=8,
)(lambda spark, sf_dir: windowed.cut(s := events(spark, sf_dir), windowed.level_trigger(s, 30.0, 2, 25), 32, 0.5, True))
_ALPHA = math.exp(-1 / (RATE * windowed.FAST))
_LEVEL = f"""WITH {EV}, a AS (SELECT * FROM ev),
    r AS (SELECT y.frame_id, y.channel_id, y.sample_idx, sum((1 - {_ALPHA!r}::DOUBLE) * pow({_ALPHA!r}::DOUBLE, y.sample_idx - x.sample_idx) * x.value * x.value) AS p
      FROM a y JOIN a x ON x.channel_id = y.channel_id AND x.sample_idx <= y.sample_idx AND x.sample_idx > y.sample_idx - 500 GROUP BY ALL)"""
query("sound_level_z", f"{_LEVEL}, result AS (SELECT {ROW}, sqrt(p) AS value FROM r)")(lambda spark, sf_dir: windowed.sound_level(events(spark, sf_dir), RATE, block=128))
query("sound_level_db", f"{_LEVEL}, result AS (SELECT {ROW}, 10 * log10(greatest(p, 1e-20::DOUBLE)) AS value FROM r)")(
    lambda spark, sf_dir: windowed.sound_level(events(spark, sf_dir), RATE, db=True, block=128)
)


def _weights(name: str, n: int) -> str:
    return "[" + ", ".join(repr(float(x)) for x in window(name, n)) + "]::DOUBLE[]"


def _dft(table: str, keys: str, n: int, value: str = "value", index: str = "sample_idx") -> str:
    """re and im of bins 0 to n / 2 of rows of `index`; products are reduced modulo n before the trigonometry."""
    turn = f"2 * pi() * (({index} * k.k) % {n}) / {n}"
    return f"SELECT {keys}, k.k AS freq_idx, sum({value} * cos({turn})) AS re, -sum({value} * sin({turn})) AS im FROM {table}, range(0, {n // 2 + 1}) k(k) GROUP BY {keys}, k.k"


_W64 = f"list_extract({_weights('hann', 64)}, CAST(sample_idx + 1 AS BIGINT))"
_ONE = "CASE WHEN freq_idx = 0 OR freq_idx = 32 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END"
_FFT = f"WITH {EMB}, f AS ({_dft('emb', BY, 64, f'value * {_W64}')}), x AS (SELECT {BY}, freq_idx, re * {_ONE} / 32 AS re, im * {_ONE} / 32 AS im FROM f)"
query("fft", f"{_FFT}, result AS (SELECT * FROM x)", "re im", "freq_idx")(lambda spark, sf_dir: spectral.fft(vectors(spark, sf_dir), 64))
query("fft_boxcar_padded", f"WITH {EMB}, f AS ({_dft('emb', BY, 96)}), result AS (SELECT {BY}, freq_idx, re * CASE WHEN freq_idx IN (0, 48) THEN 1.0 ELSE 2.0 END / 96 AS re, im * CASE WHEN freq_idx IN (0, 48) THEN 1.0 ELSE 2.0 END / 96 AS im FROM f)", "re im", "freq_idx")(
    lambda spark, sf_dir: spectral.fft(vectors(spark, sf_dir), 96, "boxcar")
)
query("fft_magnitude", f"{_FFT}, result AS (SELECT {BY}, freq_idx, sqrt(re * re + im * im) AS value FROM x)", longs="freq_idx")(
    lambda spark, sf_dir: spectral.fft(vectors(spark, sf_dir), 64).select(*KEY, "freq_idx", levels.magnitude(F.col("re"), F.col("im")).alias("value"))
)
query("fft_db", f"{_FFT}, result AS (SELECT {BY}, freq_idx, 20 * log10(greatest(sqrt(re * re + im * im), 1e-12::DOUBLE)) AS value FROM x)", longs="freq_idx")(
    lambda spark, sf_dir: spectral.fft(vectors(spark, sf_dir), 64).select(*KEY, "freq_idx", levels.level_db(levels.magnitude(F.col("re"), F.col("im"))).alias("value"))
)
query(
    "dba", f"{_FFT}, result AS (SELECT {BY}, freq_idx, 20 * log10(greatest(sqrt(re * re + im * im), 1e-12::DOUBLE)) + {levels.a_weighting_sql('(freq_idx * 500.0::DOUBLE)')} AS value FROM x)", longs="freq_idx"
)(lambda spark, sf_dir: spectral.fft(vectors(spark, sf_dir), 64).select(*KEY, "freq_idx", (levels.level_db(levels.magnitude(F.col("re"), F.col("im"))) + levels.a_weighting_db(F.col("freq_idx") * 500.0)).alias("value")))
query("a_weighting_curve", f"WITH result AS (SELECT i * 25 AS freq, {levels.a_weighting_sql('(i * 25.0::DOUBLE)')} AS value FROM range(0, 800) r(i))", "value", "freq", "")(
    lambda spark, sf_dir: spark.range(800).select((F.col("id") * 25).alias("freq"), levels.a_weighting_db(F.col("id") * 25.0).alias("value"))
)
query("ifft", f"WITH {EMB}, result AS (SELECT {ROW}, value * {_W64} AS value FROM emb)")(lambda spark, sf_dir: spectral.ifft(spectral.fft(vectors(spark, sf_dir), 64), 64))
_LOG = f"{_FFT}, l AS (SELECT {BY}, freq_idx, ln(greatest(sqrt(re * re + im * im), 1e-12::DOUBLE)) AS v FROM x)"
_CEP = f"{_LOG}, c AS (SELECT {BY}, q.q AS quef_idx, sum(v * {_ONE} * cos(2 * pi() * ((freq_idx * q.q) % 64) / 64)) / 64 AS value FROM l, range(0, 64) q(q) GROUP BY {BY}, q.q)"
query("cepstrum", f"{_CEP}, result AS (SELECT * FROM c)", longs="quef_idx")(lambda spark, sf_dir: spectral.cepstrum(vectors(spark, sf_dir), 64))
_LIFT = f"{_CEP}, h AS (SELECT {BY}, quef_idx, CASE WHEN quef_idx < 9 OR quef_idx > 55 THEN value ELSE 0 END AS value FROM c)"
query("lifter", f"{_LIFT}, result AS (SELECT * FROM h)", longs="quef_idx")(lambda spark, sf_dir: spectral.lifter(spectral.cepstrum(vectors(spark, sf_dir), 64), 64, 9))
query("lifter_high", f"{_CEP}, result AS (SELECT {BY}, quef_idx, CASE WHEN quef_idx < 9 OR quef_idx > 55 THEN 0 ELSE value END AS value FROM c)", longs="quef_idx")(
    lambda spark, sf_dir: spectral.lifter(spectral.cepstrum(vectors(spark, sf_dir), 64), 64, 9, "high")
)
query("envelope", f"{_LIFT}, result AS (SELECT {BY}, k.k AS freq_idx, exp(sum(value * cos(2 * pi() * ((quef_idx * k.k) % 64) / 64))) AS value FROM h, range(0, 33) k(k) GROUP BY {BY}, k.k)", longs="freq_idx")(
    lambda spark, sf_dir: spectral.envelope(spectral.lifter(spectral.cepstrum(vectors(spark, sf_dir), 64), 64, 9), 64)
)
# short-time spectra of whole channels: slices of 64 every 16, the first one centred on sample 0
_SLICES = f"""WITH {EV}, s AS (SELECT * FROM ev), n AS (SELECT {BY}, max(sample_idx) + 1 AS n FROM s GROUP BY ALL),
    p AS (SELECT {BY}, sample_idx, value, (sample_idx + 32 - LOW * 16) // 16 - k.k AS p FROM s, range(0, 4) k(k)),
    g AS (SELECT {BY}, p AS frame_idx, sample_idx - (p * 16 - 32 + LOW * 16) AS i, value FROM p JOIN n USING ({BY}) WHERE p >= 0 AND p < ceil((n + 31) / 16) - LOW),
    t AS (SELECT {BY}, frame_idx, i, value * list_extract({_weights('hann', 64)}, CAST(i + 1 AS BIGINT)) AS value FROM g),
    f AS ({_dft('t', BY + ', frame_idx', 64, 'value', '(i + 32)')})"""
_LOW, _ = spectral.stft_span(0, window("hann", 64), 16)
_SLICES = _SLICES.replace("- LOW", f"- ({_LOW})").replace("LOW", str(_LOW))
_LENGTHS = lambda s: s.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"))
query("stft", f"{_SLICES}, result AS (SELECT {BY}, frame_idx, freq_idx, re * {_ONE} / 32 AS re, im * {_ONE} / 32 AS im FROM f)", "re im", "frame_idx freq_idx")(
    lambda spark, sf_dir: spectral.stft(events(spark, sf_dir), None, 64, 16)
)
query("stft_frame", f"{_SLICES}, result AS (SELECT {BY}, freq_idx, re * {_ONE} / 32 AS re, im * {_ONE} / 32 AS im FROM f WHERE frame_idx = 7)", "re im", "freq_idx")(
    lambda spark, sf_dir: spectral.frame_at(spectral.stft(events(spark, sf_dir), None, 64, 16), 7)
)
query("istft", f"WITH {EV}, result AS (SELECT {ROW}, value FROM ev)")(
    lambda spark, sf_dir: spectral.istft(spectral.stft(s := events(spark, sf_dir), None, 64, 16), 64, 16, 64, "hann", _LENGTHS(s))
)
query(
    "spectrogram_magnitude", f"{_SLICES}, result AS (SELECT {BY}, frame_idx, freq_idx, sqrt(re * re + im * im) * {_ONE} / 32 AS value FROM f)", longs="frame_idx freq_idx"
)(lambda spark, sf_dir: spectral.stft(events(spark, sf_dir), None, 64, 16).select(*KEY, "frame_idx", "freq_idx", levels.magnitude(F.col("re"), F.col("im")).alias("value")))
# averaged spectra of whole channels, in pairs of what all channels have: segments of 64, half overlapping
_SEGMENTS = f"""WITH {EV}, n AS (SELECT {BY}, max(sample_idx) + 1 AS n FROM ev GROUP BY ALL), s AS (SELECT ev.*, n FROM ev JOIN n USING ({BY})),
    h AS (SELECT *, sample_idx // 32 - k.k AS p FROM s, range(0, 2) k(k)),
    g AS (SELECT {BY}, p AS frame_idx, sample_idx - p * 32 AS i, value FROM h WHERE p >= 0 AND p <= (n - 64) // 32),
    d AS (SELECT {BY}, frame_idx, i, value - avg(value) OVER (PARTITION BY {BY}, frame_idx) AS value FROM g),
    t AS (SELECT {BY}, frame_idx, i, value * list_extract({_weights('hann', 64)}, CAST(i + 1 AS BIGINT)) AS value FROM d),
    f AS ({_dft('t', BY + ', frame_idx', 64, 'value', 'i')})"""
_COMMON = _SEGMENTS.replace(f"SELECT ev.*, n FROM ev JOIN n USING ({BY})", "SELECT ev.*, least.n FROM ev, (SELECT min(n) AS n FROM n) least WHERE sample_idx < least.n")
_CSD = f"""{_COMMON}, c AS (SELECT a.frame_id, a.channel_id AS out_ch, b.channel_id AS in_ch, a.freq_idx,
      avg(b.re * a.re + b.im * a.im) * {_ONE.replace('freq_idx', 'a.freq_idx')} / 1024 AS re, avg(b.re * a.im - b.im * a.re) * {_ONE.replace('freq_idx', 'a.freq_idx')} / 1024 AS im
      FROM f a JOIN f b ON a.frame_id = b.frame_id AND a.frame_idx = b.frame_idx AND a.freq_idx = b.freq_idx GROUP BY a.frame_id, a.channel_id, b.channel_id, a.freq_idx),
    p AS (SELECT c.*, i.re AS pin, o.re AS pout FROM c JOIN c i ON i.out_ch = c.in_ch AND i.in_ch = c.in_ch AND i.freq_idx = c.freq_idx JOIN c o ON o.out_ch = c.out_ch AND o.in_ch = c.out_ch AND o.freq_idx = c.freq_idx)"""
_SHARED = lambda spark, sf_dir: pointwise.common_length(events(spark, sf_dir))
_AMPLITUDE = "CASE WHEN freq_idx = 0 OR freq_idx = 32 THEN 1.0::DOUBLE ELSE sqrt(2.0::DOUBLE) END"
query("welch", f"{_SEGMENTS}, m AS (SELECT {BY}, freq_idx, avg(re * re + im * im) AS p FROM f GROUP BY ALL), result AS (SELECT {BY}, freq_idx, sqrt(p * {_ONE} / 1024) * {_AMPLITUDE} AS value FROM m)", longs="freq_idx")(
    lambda spark, sf_dir: spectral.welch(events(spark, sf_dir), 64)
)
query(
    "welch_median", f"{_SEGMENTS}, m AS (SELECT {BY}, freq_idx, median(re * re + im * im) AS p, 1 + coalesce(list_sum([1.0::DOUBLE / (2 * k + 1) - 1.0::DOUBLE / (2 * k) for k in range(1, (count(*) - 1) // 2 + 1)]), 0) AS bias FROM f GROUP BY ALL), result AS (SELECT {BY}, freq_idx, sqrt(p / bias * {_ONE} / 1024) * {_AMPLITUDE} AS value FROM m)", longs="freq_idx"
)(lambda spark, sf_dir: spectral.welch(events(spark, sf_dir), 64, average="median"))
_PAIRS = "frame_id out_ch in_ch"
query("csd", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, re, im FROM c)", "re im", "freq_idx", _PAIRS)(lambda spark, sf_dir: spectral.csd(_SHARED(spark, sf_dir), 64))
query("csd_density", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, re * 1024 / (64 * 24.0::DOUBLE) AS re, im * 1024 / (64 * 24.0::DOUBLE) AS im FROM c)", "re im", "freq_idx", _PAIRS)(
    lambda spark, sf_dir: spectral.csd(_SHARED(spark, sf_dir), 64, scaling="density", rate=RATE)
)
query("coherence", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, (re * re + im * im) / (pin * pout) AS value FROM p)", longs="freq_idx", strings=_PAIRS)(
    lambda spark, sf_dir: spectral.coherence(_SHARED(spark, sf_dir), 64)
)
query("transfer_function", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, re / pin AS re, im / pin AS im FROM p)", "re im", "freq_idx", _PAIRS)(
    lambda spark, sf_dir: spectral.transfer_function(_SHARED(spark, sf_dir), 64)
)
query("transfer_gain_db", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, 20 * log10(sqrt(re * re + im * im) / pin) AS value FROM p WHERE out_ch <> in_ch)", longs="freq_idx", strings=_PAIRS)(
    lambda spark, sf_dir: spectral.transfer_function(_SHARED(spark, sf_dir), 64).where("out_ch <> in_ch").select("frame_id", "out_ch", "in_ch", "freq_idx", levels.unfloored_db(levels.magnitude(F.col("re"), F.col("im")), 20.0).alias("value"))
)
query("select_pair", f"{_CSD}, result AS (SELECT frame_id, out_ch, in_ch, freq_idx, re, im FROM c WHERE out_ch = 'click' AND in_ch = 'view')", "re im", "freq_idx", _PAIRS)(
    lambda spark, sf_dir: as_signal(_SHARED(spark, sf_dir)).csd(64).select_pair("click", "view").df
)
query("select_pairs", f"{_CSD}, o AS (SELECT out_ch, in_ch, row_number() OVER (ORDER BY out_ch, in_ch) - 1 AS no FROM (SELECT DISTINCT out_ch, in_ch FROM c)), result AS (SELECT frame_id, out_ch, in_ch, freq_idx, re, im FROM c JOIN o USING (out_ch, in_ch) WHERE no IN (1, 3))", "re im", "freq_idx", _PAIRS)(
    lambda spark, sf_dir: as_signal(_SHARED(spark, sf_dir)).csd(64).select_pairs([3, 1]).df
)
_BANDS = spectral.octave_bands(50, 3000)
_EDGES = ", ".join(f"({r.band_idx}, {r.center!r}::DOUBLE, {r.low!r}::DOUBLE, {r.high!r}::DOUBLE)" for r in _BANDS.itertuples())
query(
    "noct_synthesis",
    f"{_FFT}, b(band_idx, center, low, high) AS (VALUES {_EDGES}), result AS (SELECT {BY}, band_idx, center, sqrt(sum((re * re + im * im) / {_ONE})) AS value FROM x JOIN b ON freq_idx * 100.0::DOUBLE >= low AND freq_idx * 100.0::DOUBLE < high GROUP BY ALL)",
    "center value", "band_idx",
)(lambda spark, sf_dir: spectral.noct_synthesis(spectral.fft(vectors(spark, sf_dir), 64), 6400.0, 64, _BANDS))
# signals with headers: calibration, slices, channels from arrays, spectra
query("signal_calibrated", f"WITH {EV}, result AS (SELECT {ROW}, 2.0::DOUBLE * (value * CASE channel_id WHEN 'click' THEN 2.5::DOUBLE ELSE 1.0 END) + 1.0 AS value FROM ev)")(
    lambda spark, sf_dir: (2.0 * as_signal(events(spark, sf_dir)).with_calibration({"click": 2.5}) + np.float64(1.0)).df
)
query("signal_slice", f"WITH {EV}, result AS (SELECT frame_id, channel_id, sample_idx - 10 AS sample_idx, value FROM ev WHERE channel_id IN ('click', 'view') AND sample_idx >= 10 AND sample_idx < 500)")(
    lambda spark, sf_dir: as_signal(events(spark, sf_dir))[["view", "click"], 10:500].df
)
query("add_channel", f"WITH {EV}, result AS (SELECT * FROM ev UNION ALL SELECT 'events', 'c0', r.i, r.i * 0.5::DOUBLE FROM range(0, (SELECT max(sample_idx) + 1 FROM ev)) r(i))")(
    lambda spark, sf_dir: (s := as_signal(events(spark, sf_dir))).add_channel(np.arange(s.n_samples()) * 0.5, "ramp").df
)
query("spectrum_arithmetic", f"{_FFT}, result AS (SELECT {BY}, freq_idx, re + (re - 2 * im) AS re, im + (im + 2 * re) AS im FROM x)", "re im", "freq_idx")(
    lambda spark, sf_dir: ((x := as_signal(vectors(spark, sf_dir)).fft(64)) + x * (1 + 2j)).df
)


# filters and rate changes: recursions sample by sample, and sums over the taps of a low-pass
def _recursion_sql(name: str, source: str, sos: np.ndarray, steady: bool = False) -> str:
    """Tables {name}_l and {name} (frame_id, channel_id, i, y): second-order sections over source (frame_id, channel_id, i, x), one sample a step."""
    first, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = 0.0 if abs(b0 + b1 + b2) <= 1e-12 * max(abs(b0), abs(b1), abs(b2)) else (b0 + b1 + b2) / (1 + a1 + a2)
        first += [(b1 + b2 - (a1 + a2) * gain) * level, (b2 - a2 * gain) * level]
        level *= gain
    d = lambda x: f"({float(x)!r}::DOUBLE)"
    starts = ", ".join(f"{d(v if steady else 0.0)} * xs[1] AS s{k}" for k, v in enumerate(first))
    body = f"SELECT r.*, list_extract(l.xs, r.i + 2) AS u0 FROM {name} r JOIN {name}_l l ON l.frame_id = r.frame_id AND l.channel_id = r.channel_id WHERE r.i + 2 <= len(l.xs)"
    for k, row in enumerate(sos):
        body = f"SELECT *, {d(row[0])} * u{k} + s{2 * k} AS u{k + 1} FROM ({body})"
    states = ", ".join(f"{d(b1)} * u{k} - {d(a1)} * u{k + 1} + s{2 * k + 1}, {d(b2)} * u{k} - {d(a2)} * u{k + 1}" for k, (_, b1, b2, _, a1, a2) in enumerate(sos))
    return f"""{name}_l AS (SELECT frame_id, channel_id, list(x ORDER BY i) AS xs FROM {source} GROUP BY ALL),
    {name} AS (SELECT frame_id, channel_id, CAST(-1 AS BIGINT) AS i, 0.0::DOUBLE AS y, {starts} FROM {name}_l
      UNION ALL SELECT frame_id, channel_id, i + 1, u{len(sos)}, {states} FROM ({body}))"""


_X = "x AS (SELECT frame_id, channel_id, sample_idx AS i, value AS x FROM ev)"


def _zero_phase_sql(sos: np.ndarray) -> str:
    pad = extension(sos)
    return f"""WITH RECURSIVE {EV}, n AS (SELECT {BY}, max(sample_idx) + 1 AS n, arg_min(value, sample_idx) AS a, arg_max(value, sample_idx) AS z FROM ev GROUP BY ALL),
    e AS (SELECT * FROM ev JOIN n USING ({BY})),
    x AS (SELECT {BY}, sample_idx + {pad} AS i, value AS x FROM e UNION ALL SELECT {BY}, {pad} - sample_idx, 2 * a - value FROM e WHERE sample_idx BETWEEN 1 AND {pad}
      UNION ALL SELECT {BY}, 2 * n - 2 - sample_idx + {pad}, 2 * z - value FROM e WHERE sample_idx BETWEEN n - 1 - {pad} AND n - 2),
    {_recursion_sql("f", "x", sos, True)}, t AS (SELECT f.frame_id, f.channel_id, n + {2 * pad - 1} - i AS i, y AS x FROM f JOIN n USING ({BY}) WHERE i >= 0),
    {_recursion_sql("g", "t", sos, True)}, result AS (SELECT g.frame_id, g.channel_id, n + {pad - 1} - i AS sample_idx, y AS value FROM g JOIN n USING ({BY}) WHERE i >= {pad} AND i < n + {pad})"""


def _causal_sql(sos: np.ndarray) -> str:
    return f"WITH RECURSIVE {EV}, {_X}, {_recursion_sql('f', 'x', sos)}"


_RESULT = "result AS (SELECT frame_id, channel_id, i AS sample_idx, y AS value FROM f WHERE i >= 0)"
_A48 = weighting_sections("A", 48_000.0)
query("low_pass", _zero_phase_sql(butterworth_sections(4, "low", 8.0, RATE)))(lambda spark, sf_dir: filters.low_pass(events(spark, sf_dir), 8.0, RATE))
query("high_pass", _zero_phase_sql(butterworth_sections(4, "high", 8.0, RATE)))(lambda spark, sf_dir: filters.high_pass(events(spark, sf_dir), 8.0, RATE))
query("band_pass", _zero_phase_sql(butterworth_sections(4, "band", (4.0, 16.0), RATE)))(lambda spark, sf_dir: as_signal(events(spark, sf_dir)).band_pass_filter(4.0, 16.0).df)
# poles next to the unit circle: rounding errors of the two ways of adding up reach the ninth place
query("a_weighting", f"{_causal_sql(_A48)}, {_RESULT}", places=4)(lambda spark, sf_dir: as_signal(events(spark, sf_dir), 48_000.0).a_weighting().df)
query("c_weighting", f"{_causal_sql(weighting_sections('C', 48_000.0))}, {_RESULT}", places=4)(lambda spark, sf_dir: filters.frequency_weighting(events(spark, sf_dir), 48_000.0, "C"))
_SLOW = math.exp(-1 / (48_000.0 * windowed.SLOW))
query(
    "sound_level_a",
    f"""{_causal_sql(_A48)}, q AS (SELECT {BY}, i, y * y AS x FROM f WHERE i >= 0), {_recursion_sql("g", "q", np.array([[1 - _SLOW, 0, 0, 1, -_SLOW, 0]]))},
    result AS (SELECT {BY}, i AS sample_idx, 10 * log10(greatest(y, 1e-20::DOUBLE)) AS value FROM g WHERE i >= 0)""",
    places=4,
)(lambda spark, sf_dir: windowed.sound_level(filters.frequency_weighting(events(spark, sf_dir), 48_000.0), 48_000.0, windowed.SLOW, db=True))


def _resample_sql(up: int, down: int) -> str:
    taps, half = polyphase(up, down)
    listed = "[" + ", ".join(repr(float(x)) for x in taps) + "]::DOUBLE[]"
    return f"""WITH {EV}, n AS (SELECT {BY}, max(sample_idx) + 1 AS n FROM ev GROUP BY ALL),
    j AS (SELECT {BY}, r.j FROM n, range(0, (SELECT max(n) FROM n) * {up} // {down} + 1) r(j) WHERE r.j * {down} < n * {up}),
    t AS (SELECT {BY}, j, (j * {down} + {half}) // {up} - k.k AS sample_idx FROM j, range(0, {2 * half // up + 1}) k(k)),
    result AS (SELECT t.frame_id, t.channel_id, t.j AS sample_idx, sum(value * list_extract({listed}, CAST(t.j * {down} - t.sample_idx * {up} + {half} + 1 AS BIGINT))) AS value
      FROM t JOIN ev USING (frame_id, channel_id, sample_idx) WHERE t.j * {down} - sample_idx * {up} + {half} BETWEEN 0 AND {2 * half} GROUP BY t.frame_id, t.channel_id, t.j)"""


query("resample_up", _resample_sql(3, 2))(lambda spark, sf_dir: filters.resample(events(spark, sf_dir), RATE, 96.0))
query("resample_down", _resample_sql(3, 4))(lambda spark, sf_dir: as_signal(events(spark, sf_dir)).resampling(48.0).df)
sample_query(
    "signal_repeated_channel", events, EV, lambda s: as_signal(s).get_channel(["view", "click", "view"]).df,
    "SELECT * FROM s WHERE channel_id IN ('view', 'click') UNION ALL SELECT frame_id, 'view.1', sample_idx, value FROM s WHERE channel_id = 'view'",
)
query("hpss_harmonic")(lambda spark, sf_dir: filters.hpss(events(spark, sf_dir), "harmonic", n_fft=64))
query("hpss_percussive")(lambda spark, sf_dir: filters.hpss(events(spark, sf_dir), "percussive", n_fft=64))


def _pressure(spark: SparkSession, sf_dir: str) -> Signal:
    """Events as sound pressure, some 80 dB, at 48 kHz."""
    s = as_signal(events(spark, sf_dir), 48_000.0)
    return s.with_calibration([0.01] * s.n_channels)


# core loudness, its spread and decay are tested against the standard's steps one by one, not by SQL
query("loudness_steady")(lambda spark, sf_dir: loudness.steady(_pressure(spark, sf_dir)._calibrated(), 48_000.0))
query("loudness_varying")(lambda spark, sf_dir: _pressure(spark, sf_dir).loudness_zwtv().df)
query("sharpness_varying")(lambda spark, sf_dir: _pressure(spark, sf_dir).sharpness_din().df)
_OCTAVES = spectral.octave_bands(2, 20, 1)
_BAND_SQL = ", ".join(_recursion_sql(f"f{b.band_idx}", "x", butterworth_sections(3, "band", (b.low, b.high), RATE)) for b in _OCTAVES.itertuples())
_BAND_RMS = " UNION ALL ".join(f"SELECT {BY}, {b.band_idx} AS band_idx, {b.center!r}::DOUBLE AS center, sqrt(avg(y * y)) AS value FROM f{b.band_idx} WHERE i >= 0 GROUP BY ALL" for b in _OCTAVES.itertuples())
query("noct_spectrum", f"WITH RECURSIVE {EV}, {_X}, {_BAND_SQL}, result AS ({_BAND_RMS})", "center value", "band_idx")(lambda spark, sf_dir: filters.noct_spectrum(events(spark, sf_dir), RATE, _OCTAVES))
query(
    "cepstrogram",
    f"""{_SLICES}, l AS (SELECT {BY}, frame_idx, freq_idx, ln(greatest(sqrt(re * re + im * im) * {_ONE} / 32, 1e-12::DOUBLE)) AS v FROM f),
    result AS (SELECT {BY}, frame_idx, q.q AS quef_idx, sum(v * {_ONE} * cos(2 * pi() * ((freq_idx * q.q) % 64) / 64)) / 64 AS value FROM l, range(0, 64) q(q) GROUP BY {BY}, frame_idx, q.q)""",
    longs="frame_idx quef_idx",
)(lambda spark, sf_dir: spectral.cepstrogram(spectral.stft(events(spark, sf_dir), None, 64, 16), 64))
query(
    "unwrapped_phase",
    f"""{_FFT}, p AS (SELECT {BY}, freq_idx, atan2(CASE WHEN freq_idx IN (0, 32) THEN 0.0 ELSE im END, re) AS p FROM x),
    d AS (SELECT *, p - lag(p) OVER (PARTITION BY {BY} ORDER BY freq_idx) AS d FROM p),
    result AS (SELECT {BY}, freq_idx, p - 2 * pi() * sum(coalesce(round(d / (2 * pi())), 0)) OVER (PARTITION BY {BY} ORDER BY freq_idx) AS value FROM d)""",
    longs="freq_idx",
)(lambda spark, sf_dir: as_signal(vectors(spark, sf_dir)).fft(64).unwrapped_phase())
_B, _A = ([float(c) for c in x] for x in butterworth(1, "low", 8.0, RATE))
query(
    "first_order_filter",
    f"""WITH {EV}, s AS (SELECT * FROM ev),
    u AS (SELECT {ROW}, {_B[0]!r}::DOUBLE * value + {_B[1]!r}::DOUBLE * coalesce(lag(value) OVER (PARTITION BY {BY} ORDER BY sample_idx), 0) AS u FROM s),
    result AS (SELECT y.frame_id, y.channel_id, y.sample_idx, sum(pow({-_A[1]!r}::DOUBLE, y.sample_idx - x.sample_idx) * x.u) AS value FROM u y JOIN u x ON x.channel_id = y.channel_id AND x.sample_idx <= y.sample_idx AND x.sample_idx > y.sample_idx - 80 GROUP BY ALL)""",
)(lambda spark, sf_dir: filters.recursive(events(spark, sf_dir), np.array(_B), np.array(_A), block=100))
