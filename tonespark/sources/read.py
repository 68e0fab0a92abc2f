"""Reading recordings: single files, in-memory bytes, CSV tables, folders and stored signals."""

from __future__ import annotations

import random
import re
import struct
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Channel, Header, check_rate
from ..functions.tables import number_rows, unblock
from ..signal import Signal, from_numpy
from . import audio

READERS: dict[str, Callable] = {}
#: Samples of a channel in one row of a decoded file.
PART = 65_536
#: Bytes at a file's beginning in which its header is looked for before the whole file is read.
HEAD = 1 << 20
#: Most bytes that the driver takes from a URL, bytes that it takes at a time, and seconds that it waits.
DOWNLOAD, PIECE, TIMEOUT = 1 << 30, 1 << 20, 10.0


def register_file_reader(extension: str, reader: Callable) -> None:
    """reader(spark, path, **options) to a Signal, for files of an extension."""
    READERS["." + extension.lower().lstrip(".")] = reader


def supported_formats() -> list[str]:
    return sorted(READERS)


def get_file_reader(path: str) -> Callable:
    found = re.search(r"\.[^./\\]+$", path.lower())
    if not found or found[0] not in READERS:
        raise ValueError(f"no reader for {path!r}; known: {', '.join(supported_formats())}")
    return READERS[found[0]]


def read(spark: SparkSession, source, **options) -> Signal:
    """A signal from a path, a URL, bytes, or a file object, by its extension (file_type for bytes)."""
    if isinstance(source, str) and re.match(r"https?://", source, re.IGNORECASE):
        path = urllib.parse.urlsplit(source).path
        options = {"file_type": "", "source_name": path.rpartition("/")[2], **options}
        kind = options["file_type"] = options["file_type"] or path.lower()
        if get_file_reader(kind if "." in kind else f".{kind}") not in (read_audio, read_csv):
            raise ValueError("readers of one's own take paths, not URLs")
        source = download(source, *[options.pop(k, d) for k, d in (("timeout", TIMEOUT), ("max_bytes", DOWNLOAD))])
    if hasattr(source, "read"):
        source, options = source.read(), {"file_type": getattr(source, "name", ".wav"), **options}
    if isinstance(source, (bytes, bytearray, memoryview)):
        kind = options.pop("file_type", ".wav")
        return read_csv_bytes(spark, bytes(source), **options) if kind.endswith(".csv") else read_audio_bytes(spark, bytes(source), **options)
    return get_file_reader(source)(spark, source, **options)


def download(url: str, timeout: float = TIMEOUT, max_bytes: int = DOWNLOAD) -> bytes:
    """What a URL gives, on the driver; refused where it says, or turns out, to be larger than max_bytes."""
    if max_bytes < 1:
        raise ValueError("a limit of bytes is above 0")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            said = answer.headers.get("Content-Length")
            if said is not None and not said.strip().isdigit():
                raise OSError(f"{url} gives no length but {said!r}")
            if said is not None and int(said) > max_bytes:
                raise OSError(f"{url} has {said} bytes, more than {max_bytes}")
            parts, size = [], 0
            while piece := answer.read(min(PIECE, max_bytes + 1 - size)):
                parts.append(piece)
                size += len(piece)
                if size > max_bytes:
                    raise OSError(f"{url} has more than {max_bytes} bytes")
    except urllib.error.URLError as e:
        raise OSError(f"{url} cannot be read: {e}") from e
    if said is not None and size < int(said):
        raise OSError(f"{url} ended after {size} of {said} bytes")
    return b"".join(parts)


def _pick(labels: list[str], channel) -> list[int]:
    wanted = range(len(labels)) if channel is None else [channel] if isinstance(channel, int) else list(channel)
    if not all(0 <= c < len(labels) for c in wanted):
        raise ValueError("no such channel")
    return list(wanted)


def _range(rate: float, frames: int, start: float | None, end: float | None) -> tuple[int, int]:
    first = max(0, min(int((start or 0) * rate), frames))
    return first, frames if end is None else max(first, min(int(end * rate), frames))


def read_audio_bytes(spark: SparkSession, data: bytes, channel=None, start: float | None = None, end: float | None = None, ch_labels: list[str] | None = None, source_name: str = "") -> Signal:
    meta = audio.info(data)
    first, stop = _range(meta.rate, meta.frames, start, end)
    picked = _pick([""] * meta.channels, channel)
    out = from_numpy(spark, audio.decode(data, meta, first, stop)[picked], meta.rate, source_name, ch_labels or [f"ch{c}" for c in picked], "FS")
    return out.with_source_time_offset(first / meta.rate)


def decoded(files: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Files (path, content) as a long table: frame_id is the path, channels are c0, c1, ...; one row of Arrow for each part of a channel."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                meta = audio.info(content)
                first, stop = _range(meta.rate, meta.frames, start, end)
                for at in range(first, stop, PART):
                    x = audio.decode(content, meta, at, min(at + PART, stop))
                    yield pd.DataFrame({"frame_id": path, "channel_id": [f"c{i}" for i in range(len(x))], "start": at - first, "values": list(x)})

    return unblock(files.select("path", "content").mapInPandas(run, "frame_id string, channel_id string, start long, values array<double>"))


def probe(files: DataFrame) -> DataFrame:
    """rate, channels and frames of files (path, content)."""

    def run(frames):
        for pdf in frames:
            metas = [audio.info(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "rate": [m.rate for m in metas], "channels": [m.channels for m in metas], "frames": [m.frames for m in metas]})

    return files.select("path", "content").mapInPandas(run, "path string, rate double, channels int, frames long")


def open_file(path: str):
    """A file of a store that Arrow knows, to be read at any place."""
    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def header_of(path: str, length: int) -> audio.AudioInfo | None:
    """A file's header from its first bytes; None where Arrow does not reach the store, or the header does not lie there."""
    if "%" in path:  # an escape in one place, a plain sign in another
        return None
    try:
        with open_file(path) as f:
            return audio.info(f.read(min(HEAD, length)), length)
    except (OSError, ValueError, struct.error, pa.ArrowException):
        return None


def ranged(spark: SparkSession, path: str, meta: audio.AudioInfo, first: int, stop: int, channels: list[int]) -> DataFrame:
    """Samples first to stop of one file as a long table. Each task opens the file and reads the bytes of its own parts only, so a file may be larger than a row and is read by many tasks."""

    def run(frames):
        for pdf in frames:
            with open_file(path) as f:
                for at in pdf["at"]:
                    x = audio.decode_part(lambda offset, size: f.read_at(size, offset), meta, int(at), min(int(at) + PART, stop))
                    yield pd.DataFrame({"frame_id": path, "channel_id": [f"c{c}" for c in channels], "start": int(at) - first, "values": [x[c] for c in channels]})

    parts = spark.range(0, -(-(stop - first) // PART)).select((F.col("id") * PART + first).alias("at"))
    return unblock(parts.mapInPandas(run, "frame_id string, channel_id string, start long, values array<double>"))


def read_audio(spark: SparkSession, path: str, channel=None, start: float | None = None, end: float | None = None, ch_labels: list[str] | None = None, **_) -> Signal:
    """One file, decoded on the executors; the driver reads its header only.

    Tasks read the bytes of their parts of the wanted range. Where Arrow does not
    reach the store, Spark reads the whole file into one row, and the range is cut
    from that.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length").limit(2).collect()
    if not listed:
        raise FileNotFoundError(path)
    meta = header_of(*listed[0]) if len(listed) == 1 else None
    known = meta is not None
    meta = meta or probe(files).first()
    picked = _pick([""] * meta.channels, channel)
    first, stop = _range(meta.rate, meta.frames, start, end)
    df = ranged(spark, listed[0].path, meta, first, stop, picked) if known else decoded(files, start, end).where(F.col("channel_id").isin([f"c{c}" for c in picked]))
    labels = ch_labels or [f"ch{c}" for c in picked]
    channels = tuple(Channel(f"c{c}", n, "FS", offset=first / meta.rate) for c, n in zip(picked, labels, strict=True))
    return Signal(df, Header("time", meta.rate, channels, {}, path.rpartition("/")[2]), n=stop - first)


def read_csv(spark: SparkSession, path: str, time_column: int | str = 0, delimiter: str = ",", header: bool = True, ch_labels: list[str] | None = None, channel=None, start: float | None = None, end: float | None = None, **_) -> Signal:
    """A table with a time column and one column for each channel. The rate is one over the mean time step, rounded (0 steps are refused)."""
    raw = spark.read.option("header", header).option("delimiter", delimiter).option("inferSchema", True).csv(path)
    return _table(raw, time_column, ch_labels, channel, start, end, path.rpartition("/")[2])


def read_csv_bytes(spark: SparkSession, data: bytes, time_column: int | str = 0, delimiter: str = ",", header: bool = True, ch_labels=None, channel=None, start=None, end=None, source_name: str = "") -> Signal:
    import io

    pdf = pd.read_csv(io.BytesIO(data), sep=delimiter, header=0 if header else None)
    pdf.columns = [str(c) for c in pdf.columns]
    return _table(spark.createDataFrame(pdf), time_column, ch_labels, channel, start, end, source_name)


def _table(raw: DataFrame, time_column, ch_labels, channel, start, end, name: str) -> Signal:
    time = raw.columns[time_column] if isinstance(time_column, int) else time_column
    if time not in raw.columns:
        raise ValueError(f"no time column {time!r}")
    names = [c for c in raw.columns if c != time]
    kinds = dict(raw.dtypes)
    bad = [c for c in (time, *names) if kinds[c] not in ("double", "float", "int", "bigint") and not kinds[c].startswith("decimal")]
    if bad:
        raise ValueError(f"columns that are no numbers: {bad}")
    span = raw.agg(F.min(time).alias("a"), F.max(time).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if span.n < 2 or span.b == span.a:
        raise ValueError("a rate needs two different times")
    rate = check_rate(float(round((span.n - 1) / (span.b - span.a))))
    first, stop = _range(rate, span.n, start, end)
    picked = _pick(names, channel)
    kept = raw.select(F.col(f"`{time}`").cast("double").alias("_t"), *[F.col(f"`{names[c]}`").cast("double").alias(f"c{c}") for c in picked])
    numbered = number_rows(kept.withColumn("_k", F.lit(0)), ["_k"], F.floor((F.col("_t") - F.lit(float(span.a))) * rate / PART), ["_t"], "sample_idx")
    numbered = numbered.where((F.col("sample_idx") >= first) & (F.col("sample_idx") < stop)).withColumn("sample_idx", F.col("sample_idx") - first)
    long = numbered.unpivot(["sample_idx"], [f"c{c}" for c in picked], "channel_id", "value").select(F.lit("frame").alias("frame_id"), "channel_id", "sample_idx", "value")
    labels = ch_labels or [names[c] for c in picked]
    offset = float(span.a) + first / rate
    return Signal(long, Header("time", rate, tuple(Channel(f"c{c}", n, offset=offset) for c, n in zip(picked, labels, strict=True)), {}, name), n=stop - first)


for _e in ("wav", "aiff", "aif", "snd", "au"):
    register_file_reader(_e, read_audio)
register_file_reader("csv", read_csv)
read_wav = read_audio


# ---- collections ---------------------------------------------------------------


def path_metadata(files: DataFrame, root: str) -> DataFrame:
    """files with meta, from each folder below root: k=v, or else partition_0, partition_1, ... by its place; and the file's name.

    The key `name`, keys like those made here, and keys that come twice in a path
    are refused when the files are looked at.
    """
    base = F.lit(re.sub(r"^\w+:", "", root).strip("/"))
    rest = F.regexp_replace(F.regexp_replace("path", r"^(\w+:)?/*", ""), F.concat(F.lit("^"), F.regexp_replace(base, r"([.+*?^$()\[\]{}|\\])", r"\\$1"), F.lit("/?")), F.lit(""))
    parts = F.split(rest, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    named = lambda p: F.instr(p, "=") > 1
    own = F.transform(F.filter(folders, named), lambda p: F.split(p, "=", 2)[0])
    pairs = F.transform(folders, lambda p, i: F.struct(F.when(named(p), F.split(p, "=", 2)[0]).otherwise(F.concat(F.lit("partition_"), i.cast("string"))).alias("k"), F.when(named(p), F.split(p, "=", 2)[1]).otherwise(p).alias("v")))
    refuse = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("path"))).cast("map<string,string>")
    meta = F.when(F.array_contains(own, "name"), refuse("the key name is reserved")).when(F.exists(own, lambda k: k.rlike("^partition_[0-9]+$")), refuse("a key is like those of plain folders"))
    meta = meta.when(F.size(own) > F.size(F.array_distinct(own)), refuse("a key comes twice")).otherwise(F.map_from_entries(pairs))
    return files.withColumn("name", F.element_at(parts, -1)).withColumn("meta", meta)


class Recordings:
    """A lazy, ordered collection of files: a table (path, name, meta) and, once read, their signals."""

    def __init__(self, files: DataFrame, rate: float | None = None, steps: tuple = ()):
        self.files, self.rate, self.steps = files, rate, steps

    def select(self, **criteria) -> Recordings:
        """Files whose metadata equal all criteria; before anything is read. Unknown keys are refused."""
        keys = {k for (k,) in self.files.select(F.explode(F.map_keys("meta")).alias("k")).distinct().collect()} if "meta" in self.files.columns else set()
        unknown = set(criteria) - keys - {"name"}
        if unknown:
            raise KeyError(f"unknown metadata {sorted(unknown)}")
        df = self.files
        for k, v in criteria.items():
            df = df.where((F.col("name") if k == "name" else F.col("meta")[k]) == str(v))
        return Recordings(df, self.rate, self.steps)

    def paths(self) -> list[str]:
        return [r[0] for r in self.files.select("path").distinct().orderBy("path").collect()]

    def sample(self, n: int | None = None, ratio: float | None = None, seed: int | None = None) -> Recordings:
        """n files, or a share (a tenth up to ten by default), by a seed over the ordered paths."""
        paths = self.paths()
        n = min(len(paths), max(1, n) if n is not None else max(1, int(len(paths) * ratio)) if ratio is not None else max(1, min(10, int(len(paths) * 0.1)))) if paths else 0
        kept = [paths[i] for i in sorted(random.Random(seed).sample(range(len(paths)), n))]
        return Recordings(self.files.where(F.col("path").isin(kept)), self.rate, self.steps)

    def __len__(self) -> int:
        return self.files.select("path").distinct().count()

    def __getitem__(self, key: int | str) -> Recordings:
        """The recording of a number, counted from 0 in order of the paths, or all of a file name."""
        if isinstance(key, str):
            return self.get_by_label(key)
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("a recording is known by its number or its file's name")
        found = self.files.select("path").distinct().orderBy("path").offset(key).limit(1).collect() if key >= 0 else []
        if not found:
            raise IndexError(f"no recording {key}")
        return Recordings(self.files.where(F.col("path") == found[0][0]), self.rate, self.steps)

    def get_by_label(self, name: str) -> Recordings:
        return Recordings(self.files.where(F.col("name") == name), self.rate, self.steps)

    get_all_by_label = get_by_label

    def apply(self, step: Callable[[Signal], Signal]) -> Recordings:
        """A step over all recordings at once when they are read."""
        return Recordings(self.files, self.rate, (*self.steps, step))

    def trim(self, start: float, end: float) -> Recordings:
        return self.apply(lambda s: s.trim(start, end))

    def resample(self, rate: float) -> Recordings:
        return self.apply(lambda s: s.resampling(rate))

    def normalize(self, **options) -> Recordings:
        return self.apply(lambda s: s.normalize(**options))

    def stft(self, **options) -> Recordings:
        return self.apply(lambda s: s.stft(**options))

    def get_metadata(self) -> dict:
        return {"files": self.files.count(), "rate": self.rate, "steps": len(self.steps)}

    def read(self, errors: str = "failfast") -> Signal:
        """One signal of all recordings (frame_id is the path) of equal rate and channels. errors="permissive" leaves out files that cannot be read or differ."""
        content = self.files.sparkSession.read.format("binaryFile").load(self.paths())
        metas = _probe_all(content)
        good = metas.where("error IS NULL")
        first = good.orderBy("path").first()
        if first is None:
            raise ValueError("no readable file")
        odd = metas.where(F.col("error").isNotNull() | (F.col("rate") != first.rate) | (F.col("channels") != first.channels))
        if errors == "failfast" and (bad := odd.first()) is not None:
            raise ValueError(f"{bad.path}: {bad.error or 'another rate or number of channels'}")
        fit = good.where((F.col("rate") == first.rate) & (F.col("channels") == first.channels))
        df = decoded_parts(fit.where("offset IS NOT NULL"))
        if not fit.where("offset IS NULL").isEmpty():
            df = df.unionByName(decoded(content.join(fit.where("offset IS NULL").select("path"), "path", "left_semi")))
        channels = tuple(Channel(f"c{i}", f"ch{i}", "FS") for i in range(first.channels))
        out = Signal(df, Header("time", first.rate, channels, {}, "recordings"), n=None)
        if self.rate and self.rate != first.rate:
            out = out.resampling(self.rate)
        for step in self.steps:
            out = step(out)
        return out

    def metadata_table(self) -> DataFrame:
        """frame_id, name and meta of each recording, to join to what was read and to group by."""
        return self.files.select(F.col("path").alias("frame_id"), "name", *(["meta"] if "meta" in self.files.columns else []))


METAS = "path string, rate double, channels int, frames long, offset long, kind string, bytes int, order string, error string"


def _probe_all(files: DataFrame) -> DataFrame:
    """Headers of files, from their first bytes where Arrow reaches them; offset is null for files that Spark has to read whole."""

    def heads(frames):
        for pdf in frames:
            yield _metas([(p, header_of(p, n), None) for p, n in zip(pdf["path"], pdf["length"])])

    def wholes(frames):
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, replace(audio.info(content), offset=None), None))
                except ValueError as e:
                    rows.append((path, None, str(e)))
            yield _metas(rows)

    seen = files.select("path", "length").mapInPandas(heads, METAS)
    unseen = files.select("path", "content").join(seen.where("rate IS NULL").select("path"), "path", "left_semi")
    return seen.where("rate IS NOT NULL").unionByName(unseen.mapInPandas(wholes, METAS))


def _metas(rows: list[tuple]) -> pd.DataFrame:
    each = [(p, *((m.rate, m.channels, m.frames, m.offset, m.kind, m.bytes, m.order) if m else (None,) * 7), e) for p, m, e in rows]
    whole = {c.split()[0]: "Int64" for c in METAS.split(", ") if c.split()[1] in ("int", "long")}
    return pd.DataFrame(each, columns=[c.split()[0] for c in METAS.split(", ")]).astype(whole)


def decoded_parts(metas: DataFrame) -> DataFrame:
    """Files of headers (METAS) as a long table like decoded()'s; parts of files are dealt to tasks, which read their bytes only."""

    def run(frames):
        for pdf in frames:
            for path, parts in pdf.groupby("path", sort=False):
                with open_file(path) as f:
                    for row in parts.itertuples(index=False):
                        meta = audio.AudioInfo(row.rate, row.channels, row.frames, row.offset, row.kind, row.bytes, row.order)
                        x = audio.decode_part(lambda offset, size: f.read_at(size, offset), meta, row.at, row.at + PART)
                        yield pd.DataFrame({"frame_id": path, "channel_id": [f"c{i}" for i in range(len(x))], "start": row.at, "values": list(x)})

    parts = metas.where("frames > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(PART).cast("long"))))
    return unblock(parts.repartition("path", "at").sortWithinPartitions("path", "at").mapInPandas(run, "frame_id string, channel_id string, start long, values array<double>"))


def from_folder(spark: SparkSession, folder: str, sampling_rate: float | None = None, file_extensions: tuple = (".wav",), recursive: bool = False, metadata_resolver: Callable | None = None, use_path_metadata: bool = False) -> Recordings:
    """Files of a folder in order of their paths; only their names are listed."""
    if metadata_resolver and use_path_metadata:
        raise ValueError("give a resolver or path metadata, not both")
    pattern = "{" + ",".join(f"*{e}" for e in file_extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path")
    if use_path_metadata:
        return Recordings(path_metadata(files, folder), sampling_rate)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if metadata_resolver:
        resolve = F.udf(lambda p: {k: str(v) for k, v in metadata_resolver(p).items()}, "map<string,string>")
        return Recordings(files.withColumn("meta", resolve("path")), sampling_rate)
    return Recordings(files.withColumn("meta", F.create_map().cast("map<string,string>")), sampling_rate)


# ---- stored signals ------------------------------------------------------------


def save(signal: Signal, path: str, overwrite: bool = False) -> None:
    """Parquet by recording, and the header as JSON text beside it."""
    spark = signal.df.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    signal.df.write.mode(mode).partitionBy("frame_id").parquet(f"{path}/values")
    spark.createDataFrame([(signal.header.to_json(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/header")


def load(spark: SparkSession, path: str) -> Signal:
    header = Header.from_json(spark.read.text(f"{path}/header").first()[0])
    return Signal(spark.read.option("partitionColumnTypeInference", False).parquet(f"{path}/values").withColumn("frame_id", F.col("frame_id").cast("string")), header)


def to_wav(signal: Signal, path: str, frame_id: str | None = None) -> None:
    """One recording as a WAV file on the driver's disk."""
    with open(path, "wb") as f:
        f.write(audio.wav_bytes(signal.to_numpy(frame_id), signal.rate))


__all__ = ["read", "read_wav", "read_csv", "from_folder", "save", "load", "to_wav"]
