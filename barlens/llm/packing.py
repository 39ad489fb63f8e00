"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Lengths are at most the capacity, so however many pieces there are, the plan has one count for each length.
Pieces above a third of the capacity pair at most twice to a sequence: the longest takes the longest partner
that fits. Shorter ones, longest first, go where they leave the least room. The driver holds the counts and
the plan (runs of equal sequences); ranks within a length tie each piece to its place. Pieces of the whole capacity
need no rank: each is a sequence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.llm import bpe
from barlens.llm.util import keep, slices

#: A length's pieces are ranked in parts of so many; parts are at most PARTS beside one a length, so they grow beyond that.
PART_ROWS, PARTS = 250, 1 << 20


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Sequences for counts[length] pieces of each length.

    Returns columns of runs, sorted by (length, first): pieces of `length` with ranks first .. next run's first
    lie `each` to a sequence from `sequence` on, at `offset` and then `length` apart; and `total`, the number
    of sequences.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    groups: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # (sequences, room, [(length, each, offset)])
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else 0
        if b == a and left[a] < 2:
            b = large[at - 1] if at else 0
        if not b:
            n = left[a]
            groups.append((n, capacity - a, [(a, 1, 0)]))
        elif b == a:
            n = left[a] // 2
            groups.append((n, capacity - 2 * a, [(a, 2, 0)]))
            n *= 2
        else:
            n = min(left[a], left[b])
            groups.append((n, capacity - a - b, [(a, 1, 0), (b, 1, a)]))
            left[b] -= n
        left[a] -= n
        large = [x for x in large if left[x]]
    rooms: dict[int, list] = {}
    for n, room, runs in groups:
        rooms.setdefault(room, []).append((n, runs))
    order = sorted(rooms)

    def put(room: int, n: int, runs: list) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((n, runs))

    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[size]
        while c:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                put(capacity, -(-c // each), [])
                continue
            room = order[at]
            n, runs = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // size
            full, rest = min(n, c // each), 0 if c // each >= n else c % each
            used = capacity - room
            put(room - each * size, full, [*runs, (size, each, used)])
            put(room - rest * size, int(rest > 0), [*runs, (size, rest, used)])
            put(room, n - full - (rest > 0), runs)
            c -= full * each + rest
    table, base, ranks = [], 0, dict.fromkeys(counts, 0)
    for room in order:
        for n, runs in rooms[room]:
            for size, each, offset in runs:
                table.append((size, ranks[size], each, base, offset))
                ranks[size] += n * each
            base += n
    cols = np.array(sorted(table), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols, strict=True)) | {"total": np.array(base)}


def place(runs: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks (from 0 in each length)."""
    key = (runs["length"] << 44) | runs["first"]
    at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
    past = rank - runs["first"][at]
    each = runs["each"][at]
    return runs["sequence"][at] + past // each, runs["offset"][at] + past % each * length


def pieces(df: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append id 0 and cut what is longer than the capacity: (doc_id, piece, start, length, ids_crc32)."""

    def run(batches):
        vocab = bpe.load(path)
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                at, rows = [], []
                for i, ids in enumerate(vocab.encode_batch(part.column("text").to_pylist())):
                    ids += b"\0\0\0\0"
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[lo : lo + 4 * capacity]
                        at.append(i)
                        rows.append((k, lo // 4, len(piece) // 4, zlib.crc32(piece)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null text is empty: one piece, the closing id 0. Repeated rows and null ids are packed as rows of their
    own; columns other than the two named are not read; an empty table gives no rows. Sequences are numbered from 0 on,
    those of one piece of the whole capacity from -1 down. The driver gets at most PARTS + capacity counts, and sends
    out those and a plan whose size depends on the capacity only.
    """
    spark = df.sparkSession
    # `deal` is written with the pieces, so that every later look deals a piece to the same part, repeated rows too.
    deal = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())
    held = keep(pieces(df, path, capacity, id_col, text_col).withColumn("deal", deal), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = held.where(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = held.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    size = max(PART_ROWS, -(-sum(counts.values()) // PARTS))
    parts = {n: -(-c // size) for n, c in counts.items()}
    # One row for each length: hinted.
    known = F.broadcast(spark.createDataFrame([*parts.items()], "length bigint, parts bigint"))
    dealt = rest.join(known, "length").withColumn("part", F.pmod("deal", "parts"))
    first = np.zeros(capacity + 1, np.int64)
    first[[*parts]] = np.cumsum([0, *parts.values()])[:-1]
    own = np.zeros(sum(parts.values()), np.int64)
    found = dealt.groupBy("length", "part").count().toArrow()
    n, part, c = (found[x].to_numpy().astype(np.int64) for x in ("length", "part", "count"))
    own[first[n] + part] = c
    # Pieces of the same length in the parts before.
    start = np.cumsum(own) - own
    before = start - np.repeat(start[first[[*parts]]], [*parts.values()]) if parts else start
    runs = plan(counts, capacity)
    sent = spark.sparkContext.broadcast((before, first, runs))

    def run(batches):
        before, first, runs = sent.value
        for b in batches:
            n, part, own = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "own"))
            seq, offset = place(runs, n, before[first[n] + part] + own - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    kind = dict(df.dtypes)[id_col]
    placed = ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.unionByName(whole)
