"""Language identification by compression.

Each language gets a raw-content zstandard dictionary, drawn from a bounded sample of its labelled texts. A
text is compressed with every dictionary, in chunks so that all of a long text counts alike; the language of
the smallest output wins, and a narrow margin is a rejection.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.util import slices

#: Bounds of the training sample: samples per language, characters of each; and bytes per dictionary.
SAMPLES, SAMPLE_CHARS, DICT_BYTES = 1000, 300, 112_000
#: So many languages have samples and dictionaries of full size; more share the same sums. More than MOST are an error.
LANGUAGES, MOST = 64, 1792
#: Compressed bytes that are worth one step of the score, and the chunk of a text that is compressed at once.
SCALE, CHUNK = 6.0, 4096
#: What each chunk begins with: a run that compresses, or else the compressor would store a short text as it is.
LEAD = bytes(64)
#: Rejected: a text whose best and second-best outputs differ by no more than this share of the second, or this many
#: bytes. Of the held-out rows at sf 0.1 these keep 99.2 % of the rightly told and 1.7 % of those of a language left out.
MARGIN, LEAST_LEAD = 0.05, 2
UNKNOWN = "und"

#: Invented and inflected words share short runs of letters: matches of three bytes count.
_PARAMETERS = dict(window_log=18, search_log=3, min_match=3, strategy=zstandard.STRATEGY_LAZY, target_length=32)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Languages, most frequent first, and their dictionaries."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Draw the dictionaries from a table of labelled texts.

    Rows with a null text or language are left out. Of each language the distinct texts of lowest hash give one
    passage each, from a place that the hash decides: at most about 2 x SAMPLES passages of SAMPLE_CHARS characters
    a language reach the driver. Behind LANGUAGES languages, passages and dictionaries shrink with their number, so
    that all are learned; more than MOST raise a ValueError. No rows: a model without languages.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts"))
    top = counts.orderBy(F.desc("n"), "lang").limit(MOST + 1).collect()
    if not top:
        return Model((), ())
    if len(top) > MOST:
        raise ValueError(f"more than {MOST} languages")
    crowd = max(LANGUAGES, len(top))
    samples, size = SAMPLES * LANGUAGES // crowd, DICT_BYTES * LANGUAGES // crowd
    limits = df.sparkSession.createDataFrame([(r["lang"], 1.3 * samples / max(r["texts"], 1)) for r in top], "lang string, limit double")
    share = F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    at = 1 + F.pmod(F.shiftright("h", 41), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    # Hinted: MOST rows.
    drawn = rows.join(F.broadcast(limits), "lang").where(share < F.col("limit")).groupBy("lang", "h").agg(F.min(F.substring("text", at, F.lit(SAMPLE_CHARS))).alias("passage")).collect()
    own = {r["lang"]: [] for r in top}
    for x in sorted(drawn, key=lambda x: (x["h"], x["passage"])):
        own[x["lang"]].append(x["passage"])
    return Model(tuple(own), tuple(content(x[:samples], size) for x in own.values()))


def content(passages: list[str], size: int = DICT_BYTES) -> bytes:
    """A dictionary: the passages' words, each once, the most frequent last; no passage stays in one piece."""
    counts = Counter(w for p in passages for w in _WORD.findall(p.lower()))
    order = sorted(counts, key=lambda w: (counts[w], zlib.crc32(w.encode()), w))
    return " ".join(["", *order, ""]).encode("utf-8", "replace")[-size:].rjust(8, b" ")


def words(text: str) -> bytes:
    """All lower-cased words of a text in order: digits and marks tell no language."""
    return " ".join(["", *_WORD.findall(text.lower()), ""]).encode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compressors(model: Model) -> list:
    out = []
    # Tables of four bytes an entry, as small as the dictionaries of many languages are.
    log = 17 if len(model.contents) <= LANGUAGES else max(map(len, model.contents)).bit_length()
    how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, hash_log=log, chain_log=log, **_PARAMETERS)
    for content in model.contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
    return out


def sizes(model: Model, text: str) -> list[int]:
    """Bytes that the text takes with each language's dictionary."""
    raw = words(text)
    chunks = [LEAD + raw[lo : lo + CHUNK] for lo in range(0, len(raw), CHUNK)]
    return [sum([len(c.compress(x)) for x in chunks]) for c in _compressors(model)]


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, accepted). No letter, or no language learned: UNKNOWN, 0 and not accepted."""
    if text is None or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    n = sizes(model, text)
    order = sorted(range(len(n)), key=lambda i: (n[i], i))
    best = n[order[0]]
    score = 1 / sum([math.exp((best - x) / SCALE) for x in n])
    second = n[order[1]] if len(n) > 1 else math.inf
    return model.languages[order[0]], score, second - best > max(MARGIN * min(second, 1 << 62), LEAST_LEAD)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict every text's language: (id, lang_pred, score, accepted), one row per row of `df`.

    Null texts and texts without a letter give UNKNOWN, score 0, not accepted. Equal sizes go to the language
    that is more frequent in the training rows and are not accepted. Repeated rows and null ids give rows of
    their own; other columns are not read.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*[predict(model, t) for t in part.column("text").to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `df` whose text is accepted, all columns as they were."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts):
        return texts.map(lambda t: predict(sent.value, t)[2])

    return df.where(accepted(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id modulo 4 is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
