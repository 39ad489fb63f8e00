"""A public archive of daily zip-CSV files: listing, fetching, checking, reading, and the universe by date.

Layout: data/futures/{market}/daily/{type}/{symbol}/{symbol}-{type}-{yyyy-mm-dd}.zip, each with an optional
.CHECKSUM beside it. `root` is any folder that Spark reads.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlens.functions.columns import to_bool

# Fixed values of the format: columns of the two kinds of files, and the column of the event's time.
COLUMNS = {
    "aggTrades": ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker"),
    "bookTicker": ("update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "transaction_time", "event_time"),
}
TIMES = {"aggTrades": "transact_time", "bookTicker": "transaction_time"}
IDS = {"aggTrades": "agg_trade_id", "bookTicker": "update_id"}
DOUBLES = {"price", "quantity", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty"}


def prefix(data_type: str, symbol: str | None = None, market: str = "um", interval: str = "daily") -> str:
    """The folder of a data type, or of one of its symbols."""
    return f"data/futures/{market}/{interval}/{data_type}/" + (f"{symbol}/" if symbol else "")


def parse_listing(text: str) -> tuple[dict[str, int], list[str], bool, str | None]:
    """(files and sizes, folders, more to come, marker) of a listing page; ValueError where it isn't one."""
    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise ValueError("not a listing page") from e
    name = lambda tag: tag.rpartition("}")[2]
    files, folders, more, marker = {}, [], False, None
    for x in top:
        inner = {name(y.tag): y.text or "" for y in x}
        if name(x.tag) == "Contents" and "Key" in inner:
            files[inner["Key"]] = int(inner.get("Size") or 0)
        elif name(x.tag) == "CommonPrefixes" and inner.get("Prefix"):
            folders.append(inner["Prefix"])
        elif name(x.tag) == "IsTruncated":
            more = (x.text or "").strip().lower() == "true"
        elif name(x.tag) == "NextMarker":
            marker = x.text
    return files, folders, more, marker


def fetch(url: str, tries: int = 4, timeout: float = 60, wait: float = 1.5) -> bytes:
    """The bytes at a URL; a missing one is FileNotFoundError, other failures are tried again, each a while later."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise FileNotFoundError(url) from e
            if k == tries - 1:
                raise
        except OSError:
            if k == tries - 1:
                raise
        time.sleep(wait * (k + 1))
    raise ValueError("tries must be positive")


def list_prefix(base: str, where: str, get=fetch) -> tuple[dict[str, int], list[str]]:
    """All files and folders below a prefix, page by page."""
    files, folders, marker = {}, [], ""
    while True:
        page, more_folders, more, following = parse_listing(get(f"{base}?{urllib.parse.urlencode({'delimiter': '/', 'prefix': where, 'marker': marker})}").decode())
        files |= page
        folders += more_folders
        marker = following or max(page, default="")
        if not more or not marker:
            return files, folders


def download(url: str, to: str | Path, get=fetch, verify: bool = True) -> Path:
    """Fetch a zip once: its checksum is compared where there is one, its members are tested, the file appears whole."""
    to = Path(to)
    if to.exists():
        return to
    blob = get(url)
    if verify:
        try:
            if get(url + ".CHECKSUM").decode().split()[0].lower() != hashlib.sha256(blob).hexdigest():
                raise ValueError(f"checksum of {url} differs")
        except FileNotFoundError:
            pass
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        if z.testzip():
            raise ValueError(f"{url} is damaged")
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_suffix(".part")
    part.write_bytes(blob)
    part.replace(to)
    return to


def file_name(symbol: str, data_type: str, day: dt.date) -> str:
    return f"{symbol}-{data_type}-{day:%Y-%m-%d}.zip"


def day_of(name: str) -> dt.date | None:
    """The date in a zip's name; None where it isn't one."""
    found = re.search(r"(\d{4}-\d{2}-\d{2})\.zip$", name)
    try:
        return dt.date.fromisoformat(found[1]) if found else None
    except ValueError:
        return None


def days(start: str | dt.date, end: str | dt.date) -> list[dt.date]:
    """All days from `start` to `end`, both included."""
    a, b = (dt.date.fromisoformat(x) if isinstance(x, str) else x for x in (start, end))
    return [a + dt.timedelta(i) for i in range((b - a).days + 1)]


@dataclass(frozen=True)
class Archive:
    """A remote archive: `base` serves files, `list_base` listings (the same where it isn't given).

    `get` fetches a URL; a missing one is FileNotFoundError.
    """

    base: str
    list_base: str | None = None
    market: str = "um"
    verify: bool = True
    threads: int = 8
    get: Callable[[str], bytes] = fetch

    def _list(self, where: str) -> tuple[dict[str, int], list[str]]:
        return list_prefix(self.list_base or self.base, where, self.get)

    def symbols(self, data_type: str) -> list[str]:
        """Every symbol that has files."""
        return sorted(x.rstrip("/").rpartition("/")[2] for x in self._list(prefix(data_type, market=self.market))[1])

    def dates(self, data_type: str, symbol: str) -> list[dt.date]:
        """The days for which a symbol has a zip; other names are left out."""
        return sorted(d for name in self._list(prefix(data_type, symbol, self.market))[0] if (d := day_of(name)))

    def files(self, spark: SparkSession, data_type: str) -> DataFrame:
        """(symbol, date) of all files, for `universe`; symbols are listed side by side."""
        names = self.symbols(data_type)
        with ThreadPoolExecutor(self.threads) as pool:
            found = pool.map(lambda s: self.dates(data_type, s), names)
            return spark.createDataFrame([(s, d) for s, own in zip(names, found, strict=True) for d in own], "symbol string, date date")

    def mirror(self, root: str | Path, data_type: str, symbols: str | list[str], start: str | dt.date, end: str | dt.date) -> list[Path]:
        """Fetch the files of some symbols and days into a local folder that `load` reads; missing days are skipped."""
        wanted = [(s, d) for s in ([symbols] if isinstance(symbols, str) else symbols) for d in days(start, end)]

        def one(s: str, d: dt.date) -> Path | None:
            key = prefix(data_type, s, self.market) + file_name(s, data_type, d)
            try:
                return download(f"{self.base.rstrip('/')}/{key}", Path(root) / key, self.get, self.verify)
            except FileNotFoundError:
                return None

        with ThreadPoolExecutor(self.threads) as pool:
            return [p for p in pool.map(lambda x: one(*x), wanted) if p]


def _names(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and paths in a folder, of any store that Spark reads; empty where it isn't there. No contents are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName(): x.getPath().toString() for x in fs.listStatus(path)} if fs.exists(path) else {}


def catalog(spark: SparkSession, root: str, data_type: str, market: str = "um") -> DataFrame:
    """(symbol, date, path, length) of the zips below `root`; names without a date are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(f"{root.rstrip('/')}/{prefix(data_type, market=market)}")
    day = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.zip$", 1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("symbol"), F.try_to_date(day, "yyyy-MM-dd").alias("date"), "path", "length").where("date IS NOT NULL")


def symbols(files: DataFrame) -> DataFrame:
    return files.select("symbol").distinct().orderBy("symbol")


def universe(files: DataFrame) -> DataFrame:
    """(date, symbol, listed) for every day from the first to the last: whether the symbol has a file."""
    span = files.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    there = files.select("date", "symbol", F.lit(True).alias("listed")).distinct()
    return span.crossJoin(files.select("symbol").distinct()).join(there, ["date", "symbol"], "left").fillna(False, ["listed"])


def _published(sums: DataFrame) -> DataFrame:
    """(path, sum): the digest that is published for a zip."""
    return sums.select(F.regexp_replace("path", r"\.CHECKSUM$", "").alias("path"), F.lower(F.regexp_extract(F.col("content").cast("string"), r"([0-9a-fA-F]{64})", 1)).alias("sum"))


def checked(spark: SparkSession, root: str, data_type: str, market: str = "um") -> DataFrame:
    """(path, ok): whether each zip has the published digest; without one it counts as good."""
    base = f"{root.rstrip('/')}/{prefix(data_type, market=market)}"
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(base)
    sums = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.CHECKSUM").load(base)
    said = _published(sums)
    return blobs.select("path", F.sha2("content", 256).alias("own")).join(said, "path", "left").select("path", F.coalesce(F.col("own") == F.col("sum"), F.lit(True)).alias("ok"))


def unit_of(values: list) -> str:
    """ns, us or ms, by the median of epoch numbers; ms without any."""
    known = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce").dropna()
    median = float(np.median(known.astype(float))) if len(known) else 0.0
    return "ns" if median > 1e17 else "us" if median > 1e14 else "ms"


def epoch(x: str | Column, unit: str | Column) -> Column:
    """Epoch numbers in a unit (ns, us, ms) as timestamps."""
    x, unit = (F.col(c) if isinstance(c, str) else c for c in (x, unit))
    return F.when(unit == "ns", F.timestamp_micros(F.floor(x / 1000).cast("bigint"))).when(unit == "us", F.timestamp_micros(x)).otherwise(F.timestamp_millis(x))


def read_zip(content: bytes, columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The first member of a zip as text columns, in parts of about a megabyte.

    A first line that begins with no number is a header; as many fields as `columns` go by position, else by the
    header's names, or by position where there is none. Columns that aren't there are null, lines of another length
    are left out.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = z.namelist()[0]
        with z.open(name) as f:
            head = f.readline().decode("utf-8", "replace").strip().lstrip("\ufeff").split(",")
        if head == [""]:
            return
        header = not re.fullmatch(r"[-+]?[0-9.]+([eE][-+]?[0-9]+)?", head[0].strip())
        own = [*columns] if len(head) == len(columns) else [x.strip() for x in head] if header else [*columns[: len(head)], *(f"more{i}" for i in range(len(head) - len(columns)))]
        with z.open(name) as f:
            parts = pa.csv.open_csv(
                f,
                pa.csv.ReadOptions(column_names=own, skip_rows=int(header), encoding="utf8"),
                pa.csv.ParseOptions(invalid_row_handler=lambda _: "skip"),
                pa.csv.ConvertOptions(column_types=dict.fromkeys(own, pa.string()), strings_can_be_null=True, null_values=[""]),
            )
            for part in parts:
                yield pa.table({c: part.column(c) if c in own else pa.nulls(part.num_rows, pa.string()) for c in columns})


def load(spark: SparkSession, root: str, data_type: str, symbol: str | list[str], start: str | dt.date, end: str | dt.date, market: str = "um", verify: bool = True) -> DataFrame:
    """Ticks of some symbols from `start` to `end`, both included, with symbol, id and ts (TIMESTAMP, UTC).

    Only the wanted symbols' folders are listed and only the wanted days' files opened. Missing days are skipped; without
    any file the result is empty with the same columns. One task reads one file at a time, and the unit of a file's times
    is that of its first part. With `verify` a file whose published digest differs fails the query; without a
    digest it counts as good.
    """
    wanted, names = sorted({symbol} if isinstance(symbol, str) else {*symbol}), COLUMNS[data_type]
    zips, sums = {}, []
    span = {*days(start, end)}
    for s in wanted:
        there = _names(spark, f"{root.rstrip('/')}/{prefix(data_type, s, market)}")
        own = {path: s for name, path in there.items() if day_of(name) in span}
        zips |= own
        sums += [there[n] for path in own if (n := path.rpartition("/")[2] + ".CHECKSUM") in there] if verify else []
    typed = [to_bool(n).alias(n) if n == "is_buyer_maker" else F.col(n).try_cast("double" if n in DOUBLES else "bigint").alias(n) for n in names]
    schema = ", ".join(f"{n} string" for n in names) + ", symbol string, unit string"
    if not zips:
        raw = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").load([*zips]).withColumn("symbol", F.element_at(F.split("path", "/"), -2)).select("path", "symbol", "content")
        said = _published(spark.read.format("binaryFile").load(sums)) if sums else spark.createDataFrame([], "path string, sum string")
        files = files.join(said, "path", "left")

        def rows(batches):
            for batch in batches:
                for path, s, content, digest in zip(*(batch.column(c).to_pylist() for c in ("path", "symbol", "content", "sum")), strict=True):
                    if digest and hashlib.sha256(content).hexdigest() != digest:
                        raise ValueError(f"{path} differs from its published digest")
                    unit = None
                    for part in read_zip(content, names):
                        unit = unit or unit_of(part.column(TIMES[data_type]).to_pylist())
                        n = part.num_rows
                        yield from part.append_column("symbol", pa.array([s] * n)).append_column("unit", pa.array([unit] * n)).to_batches()

        raw = files.mapInArrow(rows, schema)
    ticks = raw.select("symbol", "unit", *typed)
    return ticks.withColumns({"id": F.col(IDS[data_type]), "ts": epoch(TIMES[data_type], "unit")}).drop("unit")


def load_quotes(spark: SparkSession, root: str, symbol: str | list[str], start: str | dt.date, end: str | dt.date, **options) -> DataFrame:
    """Best bids and asks: `load` of bookTicker."""
    return load(spark, root, "bookTicker", symbol, start, end, **options)


def load_trades(spark: SparkSession, root: str, symbol: str | list[str], start: str | dt.date, end: str | dt.date, **options) -> DataFrame:
    """Aggregated trades: `load` of aggTrades."""
    return load(spark, root, "aggTrades", symbol, start, end, **options)
