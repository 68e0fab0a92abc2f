"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Pieces of documents have whole lengths from 1 to the capacity, so the instance
is a table of counts by length: at most `capacity` rows, however many documents
there are. That table alone is solved on the driver. The solution is a list of
runs "ranks a to b of length L lie in sequences s, s+1, ...", which places each
piece by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .bytewords import parts
from .encoding import encoder, public_path

CAPACITY = 4096
END_ID = 1


@dataclass
class Group:
    """`times` sequences filled alike: runs of (length, copies), and the room that is left."""

    times: int
    room: int
    runs: list[tuple[int, int]] = field(default_factory=list)


def smallest(sizes: list[int], count: dict[int, int], without: int, n: int) -> list[int]:
    """The n smallest items, one item of size `without` left out."""
    out: list[int] = []
    for s in reversed(sizes):
        out += [s] * min(n - len(out), count[s] - (s == without))
        if len(out) == n:
            break
    return out


def reduce_instance(count: dict[int, int], capacity: int) -> list[Group]:
    """Martello and Toth's reduction on counts; count keeps what is not fixed.

    For an item j it looks for one feasible set with j that dominates every
    other, and fixes that set as a sequence. With at most one further item in
    any set, or a partner that fills the sequence exactly, the largest fitting
    partner does so. With at most two, it does if it is no smaller than the best
    pair; else the best pair does if it starts with that partner and no swap of
    its second item can be better. Equal items are fixed together: removing a
    dominating set leaves each condition true for the next copy.
    """
    fixed: list[Group] = []
    changed = True
    while changed:
        changed = False
        sizes = sorted((s for s, n in count.items() if n), reverse=True)
        for j in list(sizes):
            while count[j]:
                sizes = [s for s in sizes if count[s]]
                others = smallest(sizes, count, j, 3)
                room = capacity - j
                if not others or others[0] > room:
                    fixed.append(Group(count[j], room, [(j, 1)]))
                    count[j] = 0
                    changed = True
                    break
                partner = next(s for s in sizes if s <= room and count[s] - (s == j) > 0)
                chosen = None
                if partner == room or sum(others[:2]) > room or len(others) < 2:
                    chosen = (partner,)
                elif len(others) < 3 or sum(others) > room:
                    chosen = best_pair(sizes, count, j, room, partner)
                if chosen is None:
                    break
                need = {s: ((j, *chosen)).count(s) for s in {j, *chosen}}
                times = min(count[s] // k for s, k in need.items())
                if not times:  # a single copy left of a size that the set takes twice
                    break
                fixed.append(Group(times, room - sum(chosen), sorted(need.items(), reverse=True)))
                for s, k in need.items():
                    count[s] -= k * times
                changed = True
    return fixed


def best_pair(sizes: list[int], count: dict[int, int], j: int, room: int, partner: int) -> tuple[int, ...] | None:
    """Of two further items at most: the dominating single partner or pair, or None."""
    left = [s for s in sizes if count[s] - (s == j) > 0 and s < room]
    arr = np.array(left[::-1])  # ascending
    at = np.searchsorted(arr, room - arr, side="right") - 1  # the largest second item for each first
    best, pair = 0, None
    for i in np.flatnonzero(at >= 0):
        a, k = int(arr[i]), int(at[i])
        b = int(arr[k])
        if a == b and count[a] - (a == j) < 2:
            if not k:
                continue
            b = int(arr[k - 1])
        if a >= b and a + b > best:
            best, pair = a + b, (a, b)
    if pair is None:
        return None
    if partner >= best:
        return (partner,)
    a, b = pair
    if a != partner:
        return None
    between = sum(count[s] - (s == j) for s in left if b < s < a)
    above = [s for s in reversed(left) if s > b for _ in range(min(2, count[s] - (s == j)))][:2]
    if between <= 1 or (len(above) == 2 and sum(above) > room):
        return pair
    return None


def best_fit(count: dict[int, int], capacity: int) -> list[Group]:
    """Best fit of falling lengths; sequences filled alike move together."""
    rooms: list[int] = []  # ascending, distinct
    by_room: dict[int, list[Group]] = {}

    def keep(g: Group) -> None:
        if g.room not in by_room:
            insort(rooms, g.room)
            by_room[g.room] = []
        by_room[g.room].append(g)

    for size in sorted((s for s, n in count.items() if n), reverse=True):
        left = count[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                if left >= per:
                    g = Group(left // per, capacity - per * size, [(size, per)])
                else:
                    g = Group(1, capacity - left * size, [(size, left)])
                left -= g.times * g.runs[0][1]
                keep(g)
                continue
            room = rooms[at]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            per = room // size
            if left >= per:
                times = min(g.times, left // per)
                put = per
            else:
                times, put = 1, left
            keep(Group(times, room - put * size, [*g.runs, (size, put)]))
            if g.times > times:
                keep(Group(g.times - times, room, g.runs))
            left -= times * put
    return [g for groups in by_room.values() for g in groups]


def solve(count: dict[int, int], capacity: int) -> list[Group]:
    """Reduction first, best fit for the rest. count is not changed."""
    rest = dict(count)
    fixed = reduce_instance(rest, capacity)
    return fixed + best_fit(rest, capacity)


def runs_table(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), ordered by length and rank."""
    rows, sequence, rank = [], 0, {}
    for g in groups:
        offset = 0
        for size, copies in g.runs:
            rows.append((size, rank.get(size, 0), copies, sequence, offset))
            rank[size] = rank.get(size, 0) + copies * g.times
            offset += size * copies
        sequence += g.times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(table: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence and offset of pieces by length and rank."""
    # a structured key keeps the order of (length, rank) without bounds on ranks
    first = np.searchsorted(table[:, 0], lengths, side="left")
    last = np.searchsorted(table[:, 0], lengths, side="right")
    at = np.empty(len(lengths), np.int64)
    for size in np.unique(lengths):
        mine = lengths == size
        lo, hi = int(first[mine][0]), int(last[mine][0])
        at[mine] = lo + np.searchsorted(table[lo:hi, 1], ranks[mine], side="right") - 1
    size, start, copies, sequence, offset = table[at].T
    k = ranks - start
    return sequence + k // copies, offset + (k % copies) * size


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode and cut: doc_id, piece, start, length, ids (binary, little-endian u32), and each piece's rank among those of its length in its task."""

    def cut(batch_iter):
        coder, seen = encoder(tokenizer), {}
        task = TaskContext.get().partitionId()
        for batch in batch_iter:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in parts(texts):
                flat, lengths = coder.encode(texts.slice(lo, hi - lo))
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                out = []
                for i, d in enumerate(doc_ids[lo:hi]):
                    ids = np.append(flat[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        n = len(part)
                        out.append((d, k, at, n, part.tobytes(), seen.get(n, 0)))
                        seen[n] = seen.get(n, 0) + 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids", "local_rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array([task] * len(out), pa.int32())], [*names, "task"])
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary, local_rank long, task int"
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, content: Column | None = None) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity tokens.

    Result, a row for each piece: doc_id, piece, start, length, ids, sequence_id,
    offset. content takes the place of ids: an expression over a piece's columns,
    worked out before the pieces are placed. Only documents longer than a sequence are cut. Null and empty texts
    are the end id alone; repeated rows are packed as often as they come; an
    empty table gives no rows; other columns of docs are ignored.
    """
    cut = pieces(docs, tokenizer or public_path("word_bpe_49k.json"), capacity, end_id)
    # content is worked out before anything is written: ids that it replaces never reach a disk
    narrow = cut.select("doc_id", "piece", "start", "length", "local_rank", "task", F.col("ids") if content is None else content)
    with common.small_batches(docs.sparkSession):
        stored = common.stored(narrow, "pieces")
    counts = stored.groupBy("length", "task").agg(F.count(F.lit(1)).alias("_n"))
    by_length = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    table = runs_table(solve(by_length, capacity))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    held = stored.columns[-1]
    ranked = stored.join(base, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t"))).withColumn("_rank", F.col("_base") + F.col("local_rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def places(length, rank):
        import pandas as pd

        sequence, offset = place(table, length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return ranked.withColumn("_at", places("length", "_rank")).select("doc_id", "piece", "start", "length", held, "_at.sequence_id", "_at.offset")


def op3_pack_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir, "doc_id", "text"), content=F.crc32("ids").alias("ids_crc32"))
