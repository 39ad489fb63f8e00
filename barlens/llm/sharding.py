"""Sharding by extendible hashing, with DataFrame operations only.

A shard is a prefix of a 60-bit hash. All rows begin in the one shard of no bits; a shard beyond the byte limit
splits on its next bit, others don't, so that the directory is as deep as its data ask for and no deeper.
Directory sums come from one aggregate over fine cells; only cells that still have to split are looked at again. A row
finds its shard by its cell, in one join a look.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.util import keep

BITS = 60
#: Bits that cells have beyond those an even split would take, and bits that each further look adds.
FINE, MORE = 4, 8
#: Copies of one row that a task writes at most.
COPIES = 10_000


def key_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the digest of a row's id and text."""
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(h: str, bits) -> Column:
    """The first `bits` bits of a hash."""
    return F.expr(f"shiftright({h}, {BITS} - {bits})")


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The shard of every cell, for rows (h, bytes, n): a list of looks (bits, entries), entries (cell, depth, total).

    A cell is a prefix of so many bits that occurs. Its shard is its shortest prefix that needn't split, or can't since
    all its rows have one hash. Cells that have none are looked at again, with more bits.
    """
    total = rows.agg(F.sum(F.col("bytes") * F.col("n"))).first()[0] or 0
    top, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + FINE)
    looks, left = [], rows
    while True:
        cells = keep(left.groupBy(prefix("h", depth).alias("cell")).agg(F.sum(F.col("bytes") * F.col("n")).alias("total"), F.min("h").alias("lo"), F.max("h").alias("hi")), "cells")
        every = cells.select("*", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
        sums = every.groupBy("depth", "prefix").agg(F.sum("total").alias("all"), (F.sum("total") > limit).alias("over"), (F.min("lo") < F.max("hi")).alias("apart"))
        whole = keep(sums.where("NOT (over AND apart)").select("depth", "prefix", "all"), "whole")
        # Shorter prefixes all split: no task gets the cells of one.
        least = whole.agg(F.min("depth")).first()[0] or top
        found = every.where(F.col("depth") >= least).join(whole.hint("merge"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"), F.max("all").alias("total"))
        found = keep(found, "directory")
        looks.append((depth, found))
        open_ = cells.join(found.hint("merge"), "cell", "left_anti").select("cell")
        if depth == BITS or open_.isEmpty():
            return looks
        left = left.withColumn("cell", prefix("h", depth)).join(open_.hint("merge"), "cell", "left_semi").drop("cell")
        top, depth = depth, min(BITS, depth + MORE)


def assign(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard of every row: (id, bytes, depth, prefix, part), one row per row of `df`.

    A shard (depth, prefix, part) holds at most `limit` bytes of UTF-8 text, unless a single text is longer: that
    one is a shard of its own rows. Rows that repeat id and text have one hash and can't be told apart by bits:
    where they exceed the limit together, `part` deals them out in the order of their number; elsewhere it is 0.
    Null texts have no bytes; null ids hash as empty; other columns are not read; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("bigint")
    rows = df.select(F.col(id_col).alias("doc_id"), key_hash(id_col, text_col).alias("h"), size.alias("bytes"))
    rows = keep(rows.groupBy("doc_id", "h", "bytes").agg(F.count("*").alias("n")), "rows")
    # A row's cell is in the entries of one look. Entries grow with the rows: they aren't sent out.
    looked = [rows.withColumn("cell", prefix("h", bits)).join(entries.hint("merge"), "cell").drop("cell") for bits, entries in directory(rows, limit)]
    placed = reduce(DataFrame.unionByName, looked).withColumn("prefix", prefix("h", "depth"))
    each = F.greatest(F.lit(1), F.expr(f"CAST({limit} AS BIGINT) div greatest(bytes, 1)"))
    placed = placed.withColumn("each", F.when(F.col("total") > limit, each).otherwise(F.lit(1 << 62)))
    single = placed.where("n = 1").withColumn("copy", F.lit(0).cast("bigint"))
    blocks = placed.where("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}")))).repartition("h", "block")
    many = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1))).drop("block")
    return single.unionByName(many).select("doc_id", "bytes", F.col("depth").cast("int").alias("depth"), "prefix", F.expr("CAST(copy div each AS INT)").alias("part"))


def sql(limit: int) -> str:
    """The same over `documents`, for DuckDB."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
e AS (SELECT depth, h >> ({BITS} - depth) AS prefix, bytes, h FROM d, (SELECT CAST(unnest(range(0, {BITS} + 1)) AS INTEGER) AS depth)),
s AS (SELECT depth, prefix, sum(bytes) AS total, min(h) < max(h) AND sum(bytes) > {limit} AS splits FROM e GROUP BY ALL),
leaf AS (SELECT d.h, min(s.depth) AS depth FROM (SELECT DISTINCT h FROM d) d JOIN s ON s.prefix = d.h >> ({BITS} - s.depth) WHERE NOT s.splits GROUP BY d.h),
r AS (SELECT d.doc_id, d.bytes, leaf.depth, d.h >> ({BITS} - leaf.depth) AS prefix, row_number() OVER (PARTITION BY d.h) - 1 AS copy FROM d JOIN leaf USING (h))
SELECT r.doc_id, CAST(r.bytes AS BIGINT) AS bytes, r.depth, r.prefix,
  CAST(CASE WHEN s.total > {limit} THEN copy // greatest(1, {limit} // greatest(r.bytes, 1)) ELSE 0 END AS INTEGER) AS part
FROM r JOIN s USING (depth, prefix)"""
