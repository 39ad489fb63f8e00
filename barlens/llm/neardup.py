"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A document is its distinct runs of five words, each weighing (1 + ln count) x IDF. Improved consistent weighted
sampling gives it SAMPLES minima; bands of them make buckets. Documents of a bucket are compared with one
another by exact weighted Jaccard similarity until all that are at or above the threshold are linked, and
links make classes. Exact copies are one node throughout: the text's 128-bit digest.

IDF falls from 1 for runs that are not frequent to FLOOR for runs in every document. A run is frequent when so many
documents have it as make one in MOST of all words, and LEAST at least: no text has more runs than words, so that at
most MOST runs are frequent however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.util import joined, keep, mix, owners, slices, small_batches, trim, unused, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: Minima of a document, and the most that two documents at the threshold may share no bucket: one in so many.
SAMPLES, MISSES = 80, 10_000
#: Least number of documents of a frequent run, and the IDF of a run in all.
LEAST, FLOOR = 8, 0.8
#: Bound of the frequent runs, which are sent out (16 bytes each): a run counts as frequent from 1 / MOST of all words on.
MOST = 1 << 20
#: Documents of a bucket that are compared in one task, a side.
CHUNK = 128
#: A key of one row in so many is hot.
HOT = 1000
#: Documents for one task of the first count; runs that it counts together, of which it holds twice as many; and the parts in which they are sorted.
COUNT_ROWS, COUNT_RUNS, COUNT_PARTS = 8000, 1 << 22, 16

#: Edges that one task joins, and the logarithm of the most bits of the sieve that is sent out (32 MB).
EDGES, SIEVE = 200_000, 28

#: Rows of random numbers.
_TABLE = 1 << 16


def layout(threshold: float) -> tuple[int, int]:
    """(bands, minima of a band): as many minima a band as keep two documents at the threshold in a common bucket."""
    return next((SAMPLES // r, r) for r in range(SAMPLES, 0, -1) if r == 1 or (1 - threshold**r) ** (SAMPLES // r) * MISSES <= 1)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct five-word runs of each text, sorted; a shorter text with words is one run."""
    h, stops = word_hashes(texts)
    size = np.diff(stops, prepend=0)
    owner = owners(stops)
    n = max(len(h) - WORDS + 1, 0)
    run = np.zeros(n, np.uint64)
    for j in range(WORDS):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    within = owner[:n] == owner[WORDS - 1 :] if n else np.zeros(0, bool)
    of, run = owner[:n][within], mix(run[within])
    short = np.flatnonzero((size > 0) & (size < WORDS))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            at = stops[short] - size[short] + j
            there = j < size[short]
            more[there] = more[there] * np.uint64(0xC2B2AE3D27D4EB4F) + h[at[there]]
        of, run = np.concatenate([of, short]), np.concatenate([run, mix(more + np.uint64(1))])
    order = np.lexsort((run, of))
    of, run = of[order], run[order]
    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (of[1:] != of[:-1])])) if len(run) else np.zeros(0, np.int64)
    return of[first], run[first], np.diff(first, append=len(run))


class Weights:
    """The IDF of frequent runs (sorted hashes and their counts among `documents`, from `least` on); 1 for all others."""

    def __init__(self, documents: int, hashes: np.ndarray, counts: np.ndarray, least: float = LEAST):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        share = np.log(np.maximum(documents, 2) / np.maximum(counts[order], 1)) / max(np.log(np.maximum(documents, 2) / least), 1e-9)
        self.idf = FLOOR + (1 - FLOOR) * np.clip(share, 0, 1)

    def of(self, run: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weight of each run that occurs `count` times."""
        w = 1 + np.log(count)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, run), len(self.hashes) - 1)
            w = np.where(self.hashes[at] == run, w * self.idf[at], w)
        return w


def _ordered(ln_a: np.ndarray) -> np.ndarray:
    """Sampling values as the upper half of a number, in the same order."""
    bits = ln_a.astype(np.float32).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of r, ln c and b; the rows' sampling values for weight 1; multipliers."""
    rng = np.random.Generator(np.random.PCG64(20))
    r, c, b = rng.gamma(2, 1, _TABLE), rng.gamma(2, 1, _TABLE), rng.random(_TABLE)
    # ln 1 is 0, and b is under 1: the step is 0.
    return r, np.log(c), b, _ordered(np.log(c) - r * (1 - b)), rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(of: np.ndarray, run: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have runs, and their minima: one row a text.

    A minimum holds the sampling value of its run (which tells the run's table row and its step t) and 32 more
    bits of the run's hash, so that two texts share it where they share run and step. The random numbers of a
    run come from the table row that its hash times the sample's multiplier gives. Most runs weigh 1: their
    values are looked up.
    """
    r, ln_c, b, plain, odd = _tables()
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    out = np.empty((len(starts), SAMPLES), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    at = np.flatnonzero(weight != 1)
    ln_w = np.log(weight[at])
    for k in range(SAMPLES if len(starts) else 0):
        own = run * odd[k]
        row = (own >> np.uint64(48)).astype(np.int64)
        value = plain[row]
        if len(at):
            row = row[at]
            t = np.floor(ln_w / r[row] + b[row])
            value[at] = _ordered(ln_c[row] - r[row] * (t - b[row] + 1))
        out[:, k] = np.minimum.reduceat(value | (own & low), starts)
    return of[starts], out


def buckets(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of each band: one row a text."""
    out = np.empty((len(minima), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(minima), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, k])
        out[:, b] = key
    return out.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether the similarity is at or above the threshold."""
    small, large = sorted((a[1].sum(), b[1].sum()))
    return small >= threshold * large - 1e-9 and jaccard(a, b) >= threshold


def totals(df: DataFrame) -> tuple[int, int]:
    """Rows of `df` (text), and a bound of the words in them: a word takes a byte and another one apart from the next."""
    r = df.agg(F.count("text").alias("n"), F.sum((F.octet_length("text") + 1) / 2).alias("w")).first()
    return r["n"], int(r["w"] or 0)


def often(held: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The runs that occur more than `least` times in all arrays together, sorted, and their counts; one part of the hashes is sorted at a time."""
    runs, counts = [], []
    for k in range(COUNT_PARTS):
        run, n = np.unique(np.concatenate([x[x // np.uint64((1 << 64) // COUNT_PARTS) == k] for x in held]), return_counts=True)
        runs.append(run[n > least])
        counts.append(n[n > least])
    return np.concatenate(runs), np.concatenate(counts)


def counted(parts: Iterable[tuple[np.ndarray, int]], least: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """often() over the runs of parts (runs, documents), about `limit` at once, with `least` for each of their documents.

    What was read is counted when as much again is held: the last count is no small one, in which a single document's runs would be often.
    """
    held, sizes, docs = [], [], []
    for run, n in parts:
        held, sizes, docs = [*held, run], [*sizes, len(run)], [*docs, n]
        if sum(sizes) > 2 * limit:
            stop = int(np.searchsorted(np.cumsum(sizes), limit)) + 1
            yield often(held[:stop], least * sum(docs[:stop]))
            held, sizes, docs = held[stop:], sizes[stop:], docs[stop:]
    if held:
        yield often(held, least * sum(docs))


def frequent(df: DataFrame, documents: int, words: int | None = None) -> Weights:
    """Exact document counts of all frequent runs: in at least max(LEAST, words / MOST) rows of `df` (text).

    Each task of the first pass passes on what is frequent among its own rows: a run with half the needed count
    or more in all tasks together is a candidate, and no frequent run can be missed. The second pass counts the
    candidates. Candidates are at most 2 x MOST and frequent runs at most MOST, as their counts sum to words at most.
    """
    need = max(LEAST, (totals(df)[1] if words is None else words) / MOST)

    def rows(runs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(counts.astype(np.int64))], ["run", "n"])

    def local(batches):
        parts = ((shingles(part.column("text").to_pylist())[1], part.num_rows) for batch in batches for part in slices(batch))
        for found in counted(parts, need / 2 / documents, COUNT_RUNS):
            yield rows(*found)
        trim()

    def collected(batches_of, source: DataFrame, least: float) -> pa.Table:
        found = source.mapInArrow(batches_of, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return found.toArrow()

    tasks = max(1, -(-documents // COUNT_ROWS))
    likely = np.sort(collected(local, df.coalesce(tasks), need / 2)["run"].to_numpy().astype(np.int64).view(np.uint64))
    if not len(likely):
        return Weights(documents, np.zeros(0, np.uint64), np.zeros(0), need)
    sent = df.sparkSession.sparkContext.broadcast(likely)

    def exact(batches):
        likely = sent.value
        count = np.zeros(len(likely), np.int64)
        for batch in batches:
            for part in slices(batch):
                run = shingles(part.column("text").to_pylist())[1]
                at = np.minimum(np.searchsorted(likely, run), len(likely) - 1)
                count += np.bincount(at[likely[at] == run], minlength=len(likely))
        yield rows(likely[count > 0], count[count > 0])
        trim()

    found = collected(exact, df.coalesce(tasks), need)
    return Weights(documents, found["run"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.float64), need)


def _forest(pdfs):
    """Within one task: every node of its edges with the least node that it is linked to."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] if y in up else y
            x = up[x]
        return x

    for pdf in pdfs:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            ra, rb = top(bytes(a)), top(bytes(b))
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
    yield pd.DataFrame({"a": list(up), "b": [top(x) for x in up]})


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for every node of the edges (a, b), label itself included.

    Every task joins what its own edges link, EDGES of them or so; nodes that got several labels link those, and
    labels that another task labels are passed on, until neither is left. One task's edges are done at once.
    """
    left = edges.select("a", "b")
    while True:
        tasks = -(-left.count() // EDGES)
        forest = keep(left.coalesce(max(1, tasks)).mapInPandas(_forest, "a binary, b binary"), "forest")
        if tasks <= 1:
            return forest.select(F.col("a").alias("node"), F.col("b").alias("label"))
        least = forest.groupBy("a").agg(F.min("b").alias("m"))
        joined = keep(forest.join(least, "a"), "least")
        named = joined.where("a <> m").select(F.col("a").alias("m"))
        if joined.where("b <> m").isEmpty() and joined.where("a <> m").join(named, "m", "left_semi").isEmpty():
            return joined.select(F.col("a").alias("node"), F.col("m").alias("label"))
        left = keep(joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "left")


def _sieve(nodes: DataFrame) -> np.ndarray:
    """One bit for each of the nodes' leading bits: at least 16 bits a node, up to 2 ** SIEVE bits in all."""
    bits = min(SIEVE, max(20, (16 * nodes.count()).bit_length()))
    lead = F.conv(F.substring(F.hex("node"), 1, 8), 16, 10).cast("bigint")
    words = nodes.select(F.shiftright(lead, 32 - bits).alias("place")).selectExpr("shiftright(place, 5) AS word", "shiftleft(1L, CAST(place & 31 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the distinct texts of `nodes`. A bit sieve drops most other rows before texts are shuffled."""
    sent = texts.sparkSession.sparkContext.broadcast(_sieve(nodes))

    def passing(batches):
        sieve = sent.value
        shift = np.uint32(32 - (len(sieve).bit_length() + 4))
        for batch in batches:
            place = np.frombuffer(b"".join([x[:4] for x in batch.column("node").to_pylist()]), ">u4").astype(np.uint32) >> shift
            yield batch.filter(pa.array((sieve[place >> np.uint32(5)] >> (place & np.uint32(31)) & np.uint32(1)).astype(bool)))

    rows = texts.withColumn("node", node()).select("node", "text").mapInArrow(passing, "node binary, text string")
    # One row for each distinct text and task before the shuffle: copies of one text meet in no task.
    return rows.groupBy("node").agg(F.first("text").alias("text")).join(nodes.hint("merge"), "node", "left_semi")


def node(text_col: str = "text"):
    """A text's node; null for a null text."""
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def links(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(node, label) of all distinct texts that are near another one; label: the least node of the class.

    A bucket's members are compared with its least one first. In the few buckets that then still hold several classes,
    all outside the largest class are compared with all others, CHUNK by CHUNK, each pair in one bucket only: in a bucket
    of n texts of which m are outside, m x n comparisons at most, less those that links already decide.
    """
    spark = df.sparkSession
    small_batches(spark)
    bands, size = layout(threshold)
    texts = df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    documents, words = totals(texts)
    weights = spark.sparkContext.broadcast(frequent(texts, documents, words))

    def sketch(batches):
        for batch in batches:
            for part in slices(batch):
                of, run, count = shingles(part.column("text").to_pylist())
                who, minima = samples(of, run, weights.value.of(run, count))
                flat = pa.array(buckets(minima, bands, size).ravel())
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(who)), pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1, dtype=np.int32) * bands), flat)], ["node", "buckets"])
        trim()

    sketched = texts.withColumn("node", node()).select("node", "text").mapInArrow(sketch, "node binary, buckets array<bigint>")
    kept = keep(sketched.groupBy("node").agg(F.first("buckets").alias("buckets")), "bands")
    nodes, banded = kept.count(), kept.select("node", F.explode("buckets").alias("bucket"))
    found = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("print")).where("n > 1")
    # Buckets of the same members count once.
    found = keep(found.groupBy("n", "leader", "print").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "leader"), "buckets")
    members = keep(joined(banded, found, "bucket", "n", nodes, HOT), "members")
    shown = keep(texts_of(texts, keep(members.select("node").distinct(), "near")), "texts")

    def compare(batches):
        last, own = None, None
        for batch in batches:
            for part in slices(batch, "right"):
                ids, left, right = part.column("a").to_pylist(), part.column("left").to_pylist(), part.column("right").to_pylist()
                sets = _sets(right, weights.value)
                good = []
                for a, x, y in zip(ids, left, sets, strict=True):
                    if a != last:
                        last, own = a, _sets([x], weights.value)[0]
                    good.append(alike(own, y, threshold))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # A leader's text goes to one part for every CHUNK of its members, so that no task gets all of them.
    leaders = members.groupBy(F.col("leader").alias("a")).agg(F.ceil(F.max("n") / CHUNK).cast("int").alias("parts"))
    left = leaders.join(shown.select(F.col("node").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    left = left.select("a", "left", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    spread = joined(members.where("node <> leader").select("node", F.col("leader").alias("a"), "n"), leaders.join(members.groupBy(F.col("leader").alias("a")).count(), "a"), "a", "count", nodes, HOT)
    stars = spread.select("a", F.col("node").alias("b"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")).distinct()
    full = stars.join(shown.select(F.col("node").alias("b"), F.col("text").alias("right")).hint("merge"), "b").join(left.hint("merge"), ["a", "part"])
    edges = keep(full.select("a", "b", "left", "right").mapInArrow(compare, "a binary, b binary"), "links")
    labels = components(edges)
    # What the leaders didn't settle.
    named = keep(members.where("n > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("bucket", "node", "label"), "named")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    open_ = keep(open_.select("bucket", F.col("most.label").alias("most"), F.col("n"), (F.col("n") - F.col("most.c")).alias("others")), "open")
    loose = keep(joined(named, open_, "bucket", "n", nodes, HOT), "loose")
    if not loose.isEmpty():
        part = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
        own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), part(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), part(n) - 1))
        probes = loose.where("label <> most").withColumn("i", own("others", 1)).withColumn("j", every("n")).withColumn("probe", F.lit(True))
        targets = loose.withColumn("j", own("n", 2)).withColumn("i", every("others")).withColumn("probe", F.lit(False))
        cols = ("bucket", "i", "j", "probe", "node", "label", "most")
        shown = shown.join(loose.groupBy("node").agg(F.collect_set("bucket").alias("open")), "node")
        both = probes.select(*cols).unionByName(targets.select(*cols)).join(shown.hint("merge"), "node")

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            sets = _sets(pdf["text"].tolist(), weights.value)
            total = np.array([w.sum() for _, w in sets])
            up: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while up.setdefault(x, x) != x:
                    x = up[x]
                return x

            at, out = pdf["bucket"].iat[0], []
            node, label, own = [bytes(x) for x in pdf["node"]], [bytes(x) for x in pdf["label"]], [{*x.tolist()} for x in pdf["open"]]
            probe, most = pdf["probe"].to_numpy(bool), bytes(pdf["most"].iat[0])
            targets = np.flatnonzero(~probe)
            for p in np.flatnonzero(probe):
                # At the threshold, neither weighs less than that share of the other.
                fits = (total[targets] >= threshold * total[p] - 1e-9) & (threshold * total[targets] <= total[p] + 1e-9)
                for t in targets[fits].tolist():
                    # Two outside the largest class are each other's probes: once is enough.
                    once = label[t] == most or node[p] < node[t]
                    if once and top(label[p]) != top(label[t]) and min(own[p] & own[t]) == at and jaccard(sets[p], sets[t]) >= threshold:
                        up[top(label[p])] = top(label[t])
                        out.append((node[p], node[t]))
            return pd.DataFrame(out, columns=["a", "b"])

        more = keep(both.groupBy("bucket", "i", "j").applyInPandas(settle, "a binary, b binary"), "more")
        if not more.isEmpty():
            labels = components(edges.union(more))
    return labels


def _sets(texts: list[str | None], weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    of, run, count = shingles(texts)
    w = weights.of(run, count)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    return [(run[lo:hi], w[lo:hi]) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The class of every row: (id, class_id, class_size), one row per row of `df`; class_id is the least id of the class.

    Equal texts are one class, empty ones and those without words too; other texts are in a class when links of
    similarity `threshold` or more connect them. A text of fewer than five words is one run. A row with a null text
    is a class of its own. Repeated rows are in the same class; a null id gets its class's least id that is not
    null. Columns other than the two named are not read; an empty table gives no rows.
    """
    labels = links(df, text_col, threshold)
    rows = keep(df.select(F.col(id_col).alias("doc_id"), node(text_col).alias("node")), "rows")
    there = rows.where("node IS NOT NULL")
    # One row for each distinct text: no task gets all copies of one.
    texts = keep(there.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    sizes = keep(texts.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("texts")), "sizes")
    total = sizes.agg(F.sum("class_size").alias("rows"), F.sum("texts").alias("texts")).first()
    known = joined(texts.drop("least"), sizes, "label", "texts", total["texts"] or 0, HOT).select("node", "copies", "class_id", "class_size")
    found = joined(there, keep(known, "classes"), "node", "copies", total["rows"] or 0, HOT).select("doc_id", "class_id", "class_size")
    alone = rows.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return found.unionByName(alone)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, all columns as they were: the one of least id, then of least text digest.

    Rows with a null text stay. Of rows that repeat id and text one stays.
    """
    labels = links(df, text_col, threshold)
    # One row for each distinct text before the join: copies of one text meet in no task.
    rows = df.select(F.col(id_col).alias("id"), node(text_col).alias("node")).where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))
    rows = rows.join(labels, "node", "left")
    first = rows.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("w")).select(F.col("w.node").alias("kept_node"), F.col("w.id").alias("kept_id"))
    first = keep(first, "first")
    own = unused(df, "node")
    marked = df.withColumn(own, node(text_col))
    hit = marked.join(first, (marked[own] == first["kept_node"]) & marked[id_col].eqNullSafe(first["kept_id"]), "left_semi")
    return hit.dropDuplicates([own, id_col]).unionByName(marked.where(F.col(own).isNull())).drop(own)
