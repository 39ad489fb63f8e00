"""Helpers that several of the text operators share: batches, word hashes, shared folders."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Bytes of rows that Spark sends to a Python worker at once, where texts travel: its default is 10,000 rows of up to 256 MB in all.
BATCH_BYTES = 1 << 21
#: Folder of kept tables below the shared one.
KEPT = "barlens-kept"

_libc = ctypes.CDLL(None)
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have at most `limit` bytes together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 16
    if start < len(sizes):
        yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Set the session to send rows to Python at most about BATCH_BYTES at once; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, f"{BATCH_BYTES + 1}b"))
    if not 0 < set_to <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trim() -> None:
    """Give freed memory back to the system, so that an idle Python worker doesn't hold what its last task took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit hashes so that every bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _ODD if kind == "up" else pow(_ODD, -1, 1 << 64)
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        out = np.full(size, np.uint64(base & _MASK))
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind]


def _hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends_at = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    buf = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_WORD[buf].view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(parts), np.int64)
    run = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power("up", len(buf))[: len(buf)])
    h = mix((run[ends] - run[starts]) * _power("down", len(buf))[starts] + np.uint64(len("w")))
    return h, np.searchsorted(starts, ends_at, side="left")


def _cut(part: bytes) -> list[bytes]:
    """A long text in pieces of about SLICE_BYTES that end at a space or line end."""
    out = []
    while len(part) > 2 * SLICE_BYTES:
        at = max(part.rfind(b" ", 0, SLICE_BYTES), part.rfind(b"\n", 0, SLICE_BYTES))
        if at <= 0:
            break
        out.append(part[:at])
        part = part[at:]
    return [*out, part]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and for each text the place after its last word.

    A word is a run of ASCII letters, digits and non-ASCII characters; a null has none.
    """
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    if sum(map(len, parts)) <= 2 * SLICE_BYTES:
        return _hashes(parts)
    pieces = [_cut(p) for p in parts]
    found = [_hashes([x])[0] for p in pieces for x in p]
    sizes = iter([len(h) for h in found])
    return np.concatenate(found), np.cumsum([sum(next(sizes) for _ in p) for p in pieces], dtype=np.int64)


def owners(stops: np.ndarray) -> np.ndarray:
    """For each word the text that it is from."""
    return np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))


def shared_top(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Unset: a local one on a local master, else a RuntimeError."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return (top or "file:///tmp/checkpoints").rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_top(spark)}/{KEPT}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    there = {c.lower() for c in df.columns}
    return next(n for k in range(len(there) + 1) if (n := f"_{name}{k}").lower() not in there)


def clear(spark: SparkSession) -> None:
    """Delete all kept tables in the shared folder: for the end of a job, when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_top(spark)}/{KEPT}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def joined(rows: DataFrame, unique: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join with one row per key, of which `count` says how many of the `total` rows have it.

    Keys of one row in `share` or more, at most `share` of them, are sent out, so that no task gets all rows of a hot key.
    """
    hot = F.col(count) * share >= total
    sent = unique.where(hot)
    if sent.isEmpty():
        return rows.join(unique, key)
    rest = rows.join(F.broadcast(sent.select(key)), key, "left_anti").join(unique.where(~hot), key)
    return rows.join(F.broadcast(sent), key).unionByName(rest)
