"""Token ids in files of fixed-width bit packing.

Every id takes the bits that the largest id of the vocabulary needs. A file is
a run of blocks and a directory; both are read with numpy, without a loop over
ids. Files are written and committed through Spark's own file writer, so any
store that Spark can write is fine, a task can be repeated, and nothing touches
a folder of one machine.

A file holds FILE_BLOCKS blocks at most, whatever its partition has, so that a
reader never holds more than such a file.

Layout, little endian. Block: b"FWB1", u32 bits, u32 documents, u64 ids, i64
document number each, u8 has-number each, u64 ids before each document in this
file, u64 words of packed ids, 0x0A. Directory, last in the file: b"FWBD", u32
blocks, per block u64 offset, u64 ids before it, u64 documents before it; then
u64 offset of the directory, 0x0A.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .bytewords import parts
from .encoding import encoder, public_path

END_ID = 2
#: Blocks of a file at most: some 70 MB of 16-bit ids.
FILE_BLOCKS = 64


def bits_for(vocab_size: int) -> int:
    """Least bits that hold every id below vocab_size."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as 64-bit words, id k at bit k * bits. Raises where an id needs more bits."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    rows = -(-len(ids) // 64)
    block = np.zeros(rows * 64, np.uint64)
    block[: len(ids)] = ids
    block = block.reshape(rows, 64)
    out = np.zeros((rows, bits), np.uint64)
    for k in range(64):  # 64 ids fill exactly `bits` words
        word, shift = divmod(k * bits, 64)
        out[:, word] |= block[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= block[:, k] >> np.uint64(64 - shift)
    return out.reshape(-1)[: -(-len(ids) * bits // 64)]


def unpack(words: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """ids start to stop of packed words, without touching the others."""
    at = np.arange(start, stop, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    padded = np.append(words, np.uint64(0))
    low = padded[word] >> shift
    high = np.where(shift > 0, padded[np.minimum(word + 1, len(words))] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    mask = np.uint64((1 << bits) - 1)
    return ((low | high) & mask).astype(np.uint32)


def block_bytes(bits: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    has = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    starts = (before + np.cumsum(lengths) - lengths).astype("<u8")
    return b"".join([
        b"FWB1", struct.pack("<IIQ", bits, len(doc_ids), len(ids)), numbers.tobytes(), has.tobytes(), starts.tobytes(), pack(ids, bits).astype("<u8").tobytes(), b"\n",
    ])


class TokenFile:
    """Reader of one file's bytes: iterate blocks, or get one document's ids by its place."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        (at,) = struct.unpack_from("<Q", data, len(data) - 9)
        magic, n = struct.unpack_from("<4sI", data, at)
        if magic != b"FWBD" or data[-1:] != b"\n":
            raise ValueError("no token file")
        self.blocks = np.frombuffer(data, "<u8", 3 * n, at + 8).reshape(n, 3)

    def block(self, k: int):
        """(document numbers or None, ids before each in the file, ids of each, packed words, bits) of block k."""
        at = int(self.blocks[k, 0])
        magic, bits, docs, n_ids = struct.unpack_from("<4sIIQ", self.data, at)
        if magic != b"FWB1":
            raise ValueError("no block")
        at += 20
        numbers = np.frombuffer(self.data, "<i8", docs, at)
        has = np.frombuffer(self.data, np.uint8, docs, at + 8 * docs)
        starts = np.frombuffer(self.data, "<u8", docs, at + 9 * docs).astype(np.int64)
        words = np.frombuffer(self.data, "<u8", -(-n_ids * bits // 64), at + 17 * docs).astype(np.uint64)
        lengths = np.diff(starts, append=int(self.blocks[k, 1]) + n_ids)
        return [int(d) if h else None for d, h in zip(numbers, has)], starts, lengths, words, bits

    def document(self, k: int, i: int) -> np.ndarray:
        """ids of document i of block k: random access, only its own words are unpacked."""
        _, starts, lengths, words, bits = self.block(k)
        at = int(starts[i] - self.blocks[k, 1])
        return unpack(words, bits, at, at + int(lengths[i]))


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = 1 << 19, file_blocks: int = FILE_BLOCKS) -> None:
    """Encode text by doc_id and write files of file_blocks blocks at most for each partition of ascending doc_id (null first).

    Repeated doc_ids follow one another, ordered by their texts' hash. Null and
    empty texts are just the end id. Blocks hold about block_ids ids; one longer
    document makes a longer block.
    """

    def images(batch_iter):
        coder = encoder(tokenizer)
        bits = bits_for(max(coder.vocab_size, end_id + 1))
        directory, offset, ids_before, docs_before = [], 0, 0, 0

        def closed():
            tail = b"FWBD" + struct.pack("<I", len(directory) // 3) + np.array(directory, "<u8").tobytes() + struct.pack("<Q", offset)
            return pa.RecordBatch.from_arrays([pa.array([tail], pa.binary())], ["image"])

        for batch in batch_iter:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in parts(texts, 2 * block_ids):
                flat, lengths = coder.encode(texts.slice(lo, hi - lo))
                lengths = lengths + 1
                ends = np.cumsum(lengths)
                ids = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(ids), bool)
                keep[ends - 1] = False
                ids[keep] = flat
                image = block_bytes(bits, doc_ids[lo:hi], lengths, ids, ids_before)
                directory += [offset, ids_before, docs_before]
                offset += len(image)
                ids_before += len(ids)
                docs_before += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array([image[:-1]], pa.binary())], ["image"])  # the writer adds the last byte
                if len(directory) == 3 * file_blocks:
                    yield closed()
                    directory, offset, ids_before, docs_before = [], 0, 0, 0
        if directory:
            yield closed()

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("_h", F.xxhash64("text"))
        .withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "_h", "_salt")
        .sortWithinPartitions("doc_id", "_h", "_salt")
        .select("doc_id", "text")
        .mapInArrow(images, "image binary")
        .select(F.col("image").cast("string").alias("image"))
    )
    # the writer begins a new file after the directory of a full one
    with common.small_batches(docs.sparkSession):
        rows.write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks + 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files at path: file, doc_id, place in the file's ids (start), n_tokens, ids (binary, little-endian u32)."""

    def rows(batch_iter):
        for batch in batch_iter:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_buffer()
                if not data.size:
                    continue
                reader = TokenFile(memoryview(data))
                part, after = re.match(r"part-(\d+).*?-c(\d+)", file.rpartition("/")[2]).groups()
                number = (int(part) << 24) + int(after)
                for k in range(len(reader.blocks)):
                    numbers, starts, lengths, words, bits = reader.block(k)
                    ids = unpack(words, bits, 0, int(lengths.sum())).astype("<u4")
                    bounds = np.concatenate([[0], np.cumsum(lengths)])
                    raw = [ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(numbers))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(raw, pa.binary())],
                        ["file", "doc_id", "start", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(rows, "file long, doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) to token files at path and return what the files hold, as read back.

    Result: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.
    Rows repeat as often as in docs; an empty table gives no rows; other columns
    of docs are ignored.
    """
    spark = docs.sparkSession
    write_files(docs, path, tokenizer or public_path("word_bpe_49k.json"), end_id)
    with common.small_batches(spark, 8):  # whole files
        back = common.stored(read_files(spark, path).select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-index")
    totals = back.groupBy("file").agg(F.sum("n_tokens").alias("_n"))  # a row per file
    before = totals.select("file", F.coalesce(F.sum("_n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return back.join(before, "file").select("doc_id", (F.col("_before") + F.col("start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(common.documents(spark, sf_dir, "doc_id", "text"), common.shared_dir(spark, "token-files"))
