"""The text operators against libraries, brute force and round trips, and on rows of all awkward kinds."""

import random
import struct
import tracemalloc
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barlens.llm import bpe, langid, media, neardup, packing, queries, sharding, topk, toxicity, urlfilter, util, wordpiece

DIR = "/root/testdata/sf0.001"
BPE, PIECES = queries.vocabulary(queries.BPE_FILE), queries.vocabulary(queries.PIECE_FILE)
WEIRD = [None, "", " \n\t", "!!!", "a", "One two three.", "Σίσυφος İstanbul ﬁ é", "日本語のテキスト 🙂", "<|endoftext|> x<|startoftext|>", "word " * 3000, "x" * 5000, "One two three."]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(WEIRD)] + [(None, "no id at all here", "en", None), (3, "!!!", None, None), (3, "!!!", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(7) for c in ("id", "node", "label", "bucket", "h", "bytes", "n", "depth", "part", "length", "score", "piece")}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bpe_equals_library(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    own = bpe.load(BPE)
    rng = random.Random(4)
    pool = "abcdeßüñAÉZ Σσςİı ½²Ⅷ٣\n\t\x1c\x85\xa0'’s't'REllvem<|>.,!?-好本é🙂\ufeff"
    texts = [t or "" for t in WEIRD] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a" * 99, "banana" * 40]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = by_id(bpe.digest(odd, BPE), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(WEIRD):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    back = bpe.decode_table(bpe.encode_table(odd, BPE), BPE)
    assert by_id(back, "text")[5] == ("one</w> two</w> three</w> .</w>",)
    assert bpe.digest(odd.limit(0), BPE).count() == 0


def test_bpe_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    b = bpe.BPE(BPE)
    texts = ["the cat sat on that mat", "the dog ran", "the cat ran off"]
    want = [bpe.load(BPE).encode(t) for t in texts]
    assert [b.encode(t) for t in texts] == want == [b.encode(t) for t in texts]


def test_memories_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 50)
    monkeypatch.setattr(wordpiece, "REMEMBERED_CHARS", 50)
    b, a = bpe.BPE(BPE), wordpiece.load(PIECES)
    texts = ["q%dz" % i * 12 for i in range(20)] + ["small words"]
    for text in (True, False):
        b.words(texts, text)
        for t in texts:
            b.words([t], text)
        assert sum(map(len, b.young[text])) + sum(map(len, b.old[text])) <= 300
    want = [a.counts(t) for t in texts]
    assert sum(map(len, a.known)) <= 200 and [a.counts(t) for t in texts] == want
    assert [b.encode(t) for t in texts] == [bpe.load(BPE).encode(t) for t in texts]


def test_word_pieces_equal_library(odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = {"[UNK]": 0}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            p = model.id_to_piece(i)
            if p != "▁":
                vocab.setdefault(p[1:] if p[0] == "▁" else "##" + p, len(vocab))
    lib = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9))
    lib.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    got = by_id(wordpiece.token_counts(odd, PIECES), "n_tokens", "n_unknown")
    for i, t in enumerate(WEIRD):
        ids = lib.encode(t or "").ids
        assert got[i] == (len(ids), ids.count(0))
    assert wordpiece.token_counts(odd.limit(0), PIECES).count() == 0


def test_word_hashes_of_long_texts(monkeypatch):
    texts = ["one two  three\nfour " * 50, None, "", "x" * 900, "five, six é"]
    whole = util.word_hashes(texts)
    monkeypatch.setattr(util, "SLICE_BYTES", 64)
    h, stops = util.word_hashes(texts)
    assert (h == whole[0]).all() and (stops == whole[1]).all() and stops.tolist() == [200, 200, 200, 201, 204]


def test_longest_match_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        first, later = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)} for _ in range(2))
        a = wordpiece.Automaton(first, later)
        for _ in range(60):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 12)))
            at, n = 0, 0
            while at < len(word):
                size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (later if at else first)), 0)
                if not size:
                    n = -1
                    break
                at, n = at + size, n + 1
            assert a.count(word) == n, (first, later, word)


def test_media_round_trip(odd):
    rng = np.random.default_rng(5)
    for n in (1, 64, 81, 82, 1020, 1021, 1022, 2042, 9000):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        got, s = media.load(media.store(payload))
        assert got == payload and s.table_frames == len(s.offsets) and s.checked == len(s.offsets) and not s.skipped
    rows = [r for r in media.media_table(odd).collect() if r["doc_id"] is not None]
    for r in rows:
        raw = (WEIRD[r["doc_id"]] or "").encode()
        full = raw.ljust(-(-max(len(raw), 1) // 64) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), sha256(r["media"]).hexdigest())
        s = media.parse(bytes(r["media"]))
        assert r["n_samples"] == 1152 * len(r["seek_offsets"]) and s.duration * 44100 == r["n_samples"] and s.offsets == r["seek_offsets"]
    assert media.media_table(odd.limit(0)).count() == 0


def second_layer(raw, seed):
    """A layer II frame of random allocation, its checksum computed bit by bit."""
    h = media.header(raw)
    rng, each = random.Random(seed), h.kbps // h.channels
    if h.version != 10:
        widths = [4] * 4 + [3] * 7 + [2] * 19
    elif each <= 48:
        widths = [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    else:
        widths = [4] * 11 + [3] * 12 + [2] * (4 if h.rate == 48000 or each <= 80 else 7)
    bits, used = [], 0
    for band, width in enumerate(widths):
        alone = band < (4 * (h.extension + 1) if h.mode == 1 else 32)
        for _ in range(h.channels if alone else 1):
            v = rng.choice([0, 0, rng.randrange(1 << width)])
            bits += [v >> (width - 1 - i) & 1 for i in range(width)]
            used += (v > 0) * (1 if alone else h.channels)
    bits += [rng.randrange(2) for _ in range(2 * used)]
    crc = 0xFFFF
    for bit in [x >> (7 - i) & 1 for x in raw[2:] for i in range(8)] + bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 & 1) ^ bit else 0)) & 0xFFFF
    bits += [0] * (-len(bits) % 8)
    body = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    return (raw + crc.to_bytes(2, "big") + body).ljust(h.size, b"\1")


@pytest.mark.parametrize("raw", ["fffca000", "fffc8460", "fffc10c0", "fffc18c0", "fff48040", "fffce4c0"])
def test_media_checksums_of_layer_two(raw):
    stream = b"".join(second_layer(bytes.fromhex(raw), i) for i in range(6))
    s = media.parse(stream)
    assert (len(s.offsets), s.checked, s.wrong, s.samples) == (6, 6, 0, 6 * 1152)
    damaged = bytearray(stream)
    damaged[s.offsets[2] + 7] ^= 0x10
    assert media.parse(bytes(damaged)).wrong == 1


@pytest.mark.parametrize("raw", ["fffb00c4", "fffd00c0", "ffff0000", "fff300c0"])
def test_media_of_free_bitrate(raw):
    rng = random.Random(4)
    base = 4 * 150
    for padded in (False, True):
        frames = []
        for i in range(7):
            pad = padded and i % 3 == 1
            lead = bytearray(bytes.fromhex(raw))
            lead[2] |= 2 * pad
            n = base + pad * (4 if media.header(bytes(lead)).layer == 1 else 1)
            frames.append(bytes(lead) + bytes(rng.randrange(255) for _ in range(n - 4)))
        s = media.parse(b"junk" + b"".join(frames))
        assert s.offsets == [4 + sum(map(len, frames[:i])) for i in range(7)] and s.skipped == 4 and s.samples == 7 * media.header(bytes.fromhex(raw)).samples
        assert s.kbps[0] == round(8 * base * s.first.rate / s.first.samples / 1000) <= s.kbps[1]
    assert media.parse(frames[0]).offsets == [] and media.parse(frames[0] + bytes(9000)).offsets == []


def test_media_parser_takes_any_bytes(spark):
    rng = random.Random(3)
    m = media.store(bytes(range(256)) * 40)
    starts = [m, b"ID3\x04\0\x40\0\0\0\0", b"ID3\x04\0\x40\0\0\0\0" + m, b"\xff\xfb\x10\xc4" + bytes(32) + b"VBRI" + bytes(9), m + b"TAG" + bytes(125), m + b"APETAGEX" + bytes(24)]
    many = [*starts, b"", None]
    for _ in range(1500):
        x = bytearray(rng.choice(starts))
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(min(len(x), rng.choice([12, 60, 10**9])))] = rng.randrange(256)
        many.append(bytes(x[rng.choice([0, 0, rng.randrange(len(x))]) :][: rng.choice([10**9, rng.randrange(len(x) + 1), rng.randrange(60)])]))
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, audio binary").withColumns({c: F.lit(1) for c in ("id", "media", "tags")})
    got = by_id(media.parse_table(df, "doc_id", "audio").withColumnRenamed("id", "doc_id"), "feature", "n_samples", "seek_offsets")
    assert len(got) == len(many)
    for i, x in enumerate(many):
        s = media.parse(x or b"")
        assert got[i] == (media.feature(s), s.samples, s.offsets)
    assert media.parse_table(df.limit(0), "doc_id", "audio").count() == 0


def test_media_damage():
    m = media.store(bytes(range(256)) * 80)
    s = media.parse(m)
    cut = m[: s.offsets[5] + 300] + m[s.offsets[6] :]
    t = media.parse(b"junk\xff\xfbx" + cut)
    assert len(t.offsets) >= len(s.offsets) - 2 and t.skipped > 0
    wrong = bytearray(m)
    wrong[s.offsets[3] + 10] ^= 1  # side information
    assert media.parse(bytes(wrong)).wrong == 1
    with pytest.raises(ValueError):
        media.load(bytes(wrong))
    tail = m[: s.offsets[-1] + 40]
    assert media.parse(tail).truncated > 0 or media.parse(tail).skipped > 0
    tagged = m + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    assert media.parse(tagged).tags["v1:title"] == "Title" and len(media.parse(tagged).offsets) == len(s.offsets)
    items = [(0, b"Artist", "Zoë".encode()), (2, b"Cover", b"\xff\xfb"), (0, b"Year", b"1999")]
    body = b"".join(struct.pack("<II", len(v), flags) + key + b"\0" + v for flags, key, v in items)
    foot = lambda n: b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, n, 0) + bytes(8)
    got = media.parse(m + body + foot(3))
    assert (got.tags["ape:Artist"], got.tags["ape:Year"], "ape:Cover" in got.tags) == ("Zoë", "1999", False) and len(got.offsets) == len(s.offsets) and not got.skipped
    assert media.parse(m + body + foot(2)).tags.keys() - s.tags.keys() == {"ape", "ape:Artist"}
    for fake in (b"TAG".ljust(128, b"x"), b"APETAGEX".rjust(64, b"y").ljust(88, b"\1")):  # a payload that ends like a tag
        payload = fake.rjust(1344, b"z")
        assert media.load(media.store(payload))[0] == payload
    assert media.parse(b"").offsets == [] and media.header(b"\xff\xff\xff\xff") is None
    layer1 = media.header(bytes([0xFF, 0xFF, 0x10, 0x00]))
    assert (layer1.layer, layer1.size, layer1.samples) == (1, 32 * 12000 // 44100 * 4, 384)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 10)).round(1)
    x[100:110] = x[0]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(600, None), (700, [1.0, None]), (800, [float("nan")] * 10), (900, []), (1000, [1.0] * 4), (None, [0.5] * 10), (100, [0.1] * 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    good = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(np.int64)) for i, v in rows if i is not None and v and len(v) == 10 and np.isfinite([float("nan") if y is None else y for y in v]).all()]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    for i, q in good:
        if i % 50 or i == 100:
            continue
        best = sorted(((-int(q @ v), j) for j, v in good if j != i))[:10]
        assert [got[i, k + 1] for k in range(10)] == [(j, -s) for s, j in best]
    assert not [k for k in got if k[0] in (600, 700, 800, 900, 1000)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(i % 300), [float(v) for v in rng.normal(size=6).round(1)]) for i in range(900)] + [(7, [0.5] * 6)] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = lambda: sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 7).collect()))
    whole = found()
    monkeypatch.setattr(topk, "QUERY_BYTES", 5 * 48)
    monkeypatch.setattr(topk, "VECTOR_BYTES", 100 * 48)
    assert found() == whole and len(whole) == 150


def test_top_k_prunes_and_big_numbers():
    rng = np.random.default_rng(1)
    base = rng.integers(-500, 500, (40, 64))
    x = np.repeat(base, 100, axis=0) + rng.integers(-3, 4, (4000, 64))
    ids = np.arange(4000)
    i, v, s, n = topk.search(x[:50], ids[:50], x, ids, 10)
    assert n < 50 * 4000 * 0.7
    full = x[:50] @ x.T
    for q in range(50):
        best = sorted((-int(full[q, j]), j) for j in ids if j != q)[:10]
        assert sorted(zip((-s[i == q]).tolist(), v[i == q].tolist(), strict=True)) == best
    big = np.array([[1 << 30, 3], [1 << 30, 5], [7, 1 << 29]], np.int64)
    i, v, s, _ = topk.search(big[:1], np.array([0]), big, np.arange(3), 2)
    assert dict(zip(v.tolist(), s.tolist(), strict=True)) == {1: (1 << 60) + 15, 2: 7 * (1 << 30) + 3 * (1 << 29)}


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark, docs):
    p = docs.toPandas()
    w = neardup.frequent(docs.select("text"), len(p))
    sets = neardup._sets(p["text"].tolist(), w)
    ids = p["doc_id"].tolist()
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if p["text"][i] == p["text"][j] or neardup.jaccard(sets[i], sets[j]) >= neardup.THRESHOLD]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == closure(pairs, ids) and len({*got.values()}) < len(got)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({*got.values()})


def similar_pairs(texts, sets, threshold):
    """All pairs of texts at or above the threshold: by every run that two share, none left out."""
    holders, pairs = {}, []
    for i, (run, _) in enumerate(sets):
        for r in run.tolist():
            holders.setdefault(r, []).append(i)
    met = {(a, b) for own in holders.values() for j, b in enumerate(own) for a in own[:j]}
    for a, b in met:
        if texts[a] == texts[b] or neardup.jaccard(sets[a], sets[b]) >= threshold:
            pairs.append((a, b))
    first = {}
    return pairs + [(first.setdefault(t, i), i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_recall_of_near_duplicates(spark, threshold):
    """On 1,000 documents every class is that of brute force: no link lost, no false one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = docs.select("doc_id", "text").toPandas()
    texts = p["text"].tolist()
    sets = neardup._sets(texts, neardup.frequent(docs.select("text"), len(p)))
    ids, pairs = p["doc_id"].tolist(), similar_pairs(texts, sets, threshold)
    near = [(a, b) for a, b in pairs if texts[a] != texts[b]]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, threshold=threshold).collect()}
    assert len(near) >= (12 if threshold == 0.8 else 90)
    assert np.mean([got[ids[a]] == got[ids[b]] for a, b in near]) >= (1.0 if threshold == 0.8 else 0.98)
    assert {(a, b) for a, b in got.items()} <= {*closure([(ids[a], ids[b]) for a, b in pairs], ids).items()} or threshold < 0.8


def test_layout_of_bands():
    assert neardup.layout(0.8) == (20, 4)
    for t in (0.3, 0.5, 0.7, 0.9, 0.95):
        bands, rows = neardup.layout(t)
        assert bands * rows <= neardup.SAMPLES and (rows == 1 or (1 - t**rows) ** bands <= 1 / neardup.MISSES)


def test_clashing_names_stay(spark, odd):
    df = odd.withColumns({c: F.lit(c) for c in ("_node", "_NODE0", "_node1", "class_id", "kept_node", "kept_id", "least", "copies", "own")})
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.first()["_node"] == "_node"
    assert kept.count() == neardup.keep_one(odd).count()


def test_frequent_runs_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST", 4)
    texts = [r["text"] for r in docs.collect()] * 2
    count = Counter(h for t in texts for h in neardup.shingles([t])[1].tolist())
    w = neardup.frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), len(texts))
    assert sorted(w.hashes.tolist()) == sorted(h for h, c in count.items() if c >= 4)


def test_frequent_runs_of_long_texts_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST", 1)
    texts = [r["text"] for r in docs.collect()] * 2
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = neardup.totals(df)[1]
    most = words // 4
    monkeypatch.setattr(neardup, "MOST", most)
    assert words >= sum(len((t or "").split()) for t in texts)
    count = Counter(h for t in texts for h in neardup.shingles([t])[1].tolist())
    w = neardup.frequent(df, len(texts))
    assert sorted(w.hashes.tolist()) == sorted(h for h, c in count.items() if c >= words / most)
    assert 0 < len(w.hashes) <= most and ((w.idf >= neardup.FLOOR) & (w.idf <= 1)).all()


def test_counting_runs_holds_little_beside_them():
    rng = np.random.default_rng(3)
    held = [rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(100)]
    held += [held[k][: 50 * k] for k in range(9)] * 4
    run, n = np.unique(np.concatenate(held), return_counts=True)
    tracemalloc.start()
    found = neardup.often(held, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(found[0], run[n > 3]) and np.array_equal(found[1], n[n > 3]) and len(found[0]) == 1800
    # Sorting all at once takes about six times as much as they do.
    assert most < sum(x.nbytes for x in held)


def test_last_count_of_a_task_is_no_small_one():
    rng = np.random.default_rng(4)
    parts = [(np.unique(rng.integers(0, 40_000, 1000)).astype(np.uint64) << np.uint64(48), 10) for _ in range(41)]
    total = Counter(np.concatenate([x for x, _ in parts]).tolist())
    every = Counter()
    for run, n in neardup.counted(iter(parts), 0, 8000):
        every.update(dict(zip(run.tolist(), n.tolist(), strict=True)))
    assert every == total
    # Of 41 parts some remain behind each full count; the last count takes a share of the documents as large as the others'.
    assert [len(run) for run, _ in neardup.counted(iter(parts), 1 / 10, 8000)] == [0] * 4
    assert [len(n) > 5000 for _, n in neardup.counted(iter(parts), 0, 8000)] == [True] * 4


def test_rows_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(6000).select(F.repeat(F.lit("x"), 4000).alias("text")).coalesce(1)

    def most():
        return df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").agg(F.max("n")).first()[0]

    spark.conf.unset(name)
    assert most() > 5 * util.BATCH_BYTES
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, queries.table(spark, "/root/testdata/sf0.001", "documents"), "/root/testdata/sf0.001")
            assert most() < 1.1 * util.BATCH_BYTES
        spark.conf.set(name, "1m")
        util.small_batches(spark)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_weighted_sampling_estimates_similarity():
    """Over 80 pairs of texts of uneven weights: no bias, and the error of 80 samples a pair."""
    rng = random.Random(9)
    error = []
    for _ in range(80):
        words = ["w%d" % rng.randrange(10**6) for _ in range(200)]
        a = [w for i in range(0, 200, 10) for w in words[i : i + 10] * rng.choice([1, 1, 2, 5])]
        b = list(a)
        for i in range(0, len(b), rng.choice([9, 30, 90])):
            b[i] = "other%d" % rng.randrange(10**6)
        texts = [" ".join(a), " ".join(b)]
        of, run, n = neardup.shingles(texts)
        often = np.unique(run)[::3]
        w = neardup.Weights(10_000, often, np.full(len(often), 500.0))
        _, minima = neardup.samples(of, run, w.of(run, n))
        error.append((minima[0] == minima[1]).mean() - neardup.jaccard(*neardup._sets(texts, w)))
    # The deviation of one share of 80 samples is at most 0.056, that of 80 such shares' mean 0.0063.
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.075


def test_sampling_values_are_those_of_the_formula():
    r, ln_c, b, plain, odd = neardup._tables()
    run, weight = np.array([3, 99, 12345], np.uint64), np.array([1.0, 2.5, 0.8])
    _, got = neardup.samples(np.zeros(3, np.int64), run, weight)
    for k in range(neardup.SAMPLES):
        best = None
        for x, w in zip(run.tolist(), weight.tolist(), strict=True):
            h = x * int(odd[k]) % 2**64
            row = h >> 48
            t = np.floor(np.log(w) / r[row] + b[row])
            y = np.exp(r[row] * (t - b[row]))
            value = np.float32(np.log(np.exp(ln_c[row]) / (y * np.exp(r[row]))))
            best = min(best or (np.inf, 0), (value, h & 0xFFFFFFFF))
        assert int(got[0, k]) & 0xFFFFFFFF == best[1]


def test_buckets_of_many_classes(spark, monkeypatch):
    """Chains: neighbours are alike, ends aren't; the leader of a bucket can't link them all."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = random.Random(2)
    text = ["w%d" % rng.randrange(10**6) for _ in range(120)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(text)))
        text[(4 * i) % 120] = "x%d" % i
    got = {r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EDGES", 7)
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    edges = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in pairs], "a binary, b binary").repartition(6)
    got = {int(bytes(r["node"])): int(bytes(r["label"])) for r in neardup.components(edges).collect()}
    nodes = {x for p in pairs for x in p}
    assert got == closure(pairs, nodes)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(odd).collect()]
    assert len(got) == odd.count()
    assert sorted(x for x in got if x[0] == 3) == [(3, 3, 3)] * 3 and (11, 5, 2) in got and (0, 0, 1) in got and (None, None, 1) in got
    kept = neardup.keep_one(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["None", *(str(i) for i in range(11))])
    assert neardup.classes(odd.limit(0)).count() == 0 and neardup.keep_one(odd.limit(0)).count() == 0


def test_classes_of_hot_and_other_groups(spark, monkeypatch):
    texts = spark.createDataFrame([(i, None if i % 4 == 0 else "one two three four five six" if i % 4 == 1 else f"text of number {i // 8} which some share") for i in range(80)], "doc_id long, text string")
    want = by_id(neardup.classes(texts), "class_id", "class_size")
    assert want[4] == (4, 1) and want[77] == (1, 20) and len(want) == 80
    for share in (1, 5):
        monkeypatch.setattr(neardup, "HOT", share)
        assert by_id(neardup.classes(texts), "class_id", "class_size") == want


def packed_right(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seqs)


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    for df, capacity in ((odd, 64), (docs, 2048), (docs, 100)):
        rows = packing.pack(df, BPE, capacity).collect()
        used = packed_right(rows, capacity)
        total = sum(r["length"] for r in rows)
        assert -(-total // capacity) <= used <= 1.02 * total / capacity + 3
        want = Counter()
        for d in df.select("doc_id", "text").collect():
            ids = [*lib.encode(d["text"] or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), capacity):
                piece = ids[k : k + capacity]
                want[d["doc_id"], k // capacity, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
        assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert packing.pack(odd.limit(0), BPE).count() == 0


def test_packing_of_whole_pieces_and_repeated_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(1, "word " * 400), (None, "two words")] * 40 + [(i, "one two three " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for most in (1 << 20, 5):
        monkeypatch.setattr(packing, "PARTS", most)
        out = packing.pack(df, BPE, 50).collect()
        used = packed_right(out, 50)
        whole = [r["sequence_id"] for r in out if r["length"] == 50]
        assert len(whole) == 8 * 40 + 0 and len({*whole}) == len(whole) and max(whole) < 0
        assert sum(r["length"] for r in out) == sum(len(bpe.load(BPE).encode(t)) + 1 for _, t in rows)
        assert used <= 1.02 * sum(r["length"] for r in out) / 50 + 3
    with_docs = packing.pack(docs, BPE, 300).collect()
    packed_right(with_docs, 300)


def test_packing_plan():
    rng = random.Random(8)
    for _ in range(200):
        capacity = rng.choice([7, 64, 2048])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        runs = packing.plan(counts, capacity)
        length = np.repeat([*counts], [*counts.values()]).astype(np.int64)
        rank = np.concatenate([np.arange(c) for c in counts.values()])
        seq, offset = packing.place(runs, length, rank)
        rows = [{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip(seq.tolist(), offset.tolist(), length.tolist(), strict=True)]
        assert packed_right(rows, capacity) == int(runs["total"])
        large = Counter(s for s, n in zip(seq.tolist(), length.tolist(), strict=True) if 3 * n > capacity)
        assert max(large.values(), default=0) <= 2
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    held = got[got.held_out & (got.n_chars > 60)]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.accepted.mean() > 0.98
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND n_chars > 60")
    learned, held = docs.where(~langid.held_out()), docs.where(langid.held_out())
    kept, strange = [], []
    for lang in ("de", "en", "es", "fr"):
        model = langid.fit(learned.where(F.col("lang") != lang))
        for r in held.select("text", "lang").collect():
            (strange if r["lang"] == lang else kept).append(langid.predict(model, r["text"])[2])
    assert len(strange) > 100 and np.mean(strange) < 0.06 and np.mean(kept) > 0.98


def test_language_of_odd_rows(spark, odd, docs):
    model = langid.fit(docs)
    got = by_id(langid.identify(odd, model), "lang_pred", "score", "accepted")
    for i in (0, 1, 2, 3):
        assert got[i] == ("und", 0.0, False)
    assert langid.identify(odd, model).count() == odd.count()
    assert {r["doc_id"] for r in langid.keep_identified(odd, model).collect()} == {i for i, x in got.items() if x[2]}
    empty = langid.fit(odd.limit(0))
    assert empty.languages == () and by_id(langid.identify(odd, empty), "lang_pred")[5] == ("und",)
    one = langid.fit(docs.where("lang = 'fr'"))
    assert by_id(langid.identify(odd, one), "lang_pred")[5] == ("fr",)


def test_language_equals_plain_compression(spark, docs):
    """Every text of the table, each with a compressor made for it alone; equal sizes go to the language learned first."""
    import regex
    import zstandard

    model = langid.fit(docs.where(~langid.held_out()))
    got = by_id(langid.identify(docs, model), "lang_pred", "accepted")
    for r in docs.select("doc_id", "text").collect():
        words = regex.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        if not words:
            assert got[r["doc_id"]] == ("und", False)
            continue
        raw = (" " + " ".join(words) + " ").encode()
        sizes = []
        for own in model.contents:
            how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, strategy=zstandard.STRATEGY_LAZY, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            c = zstandard.ZstdCompressor(compression_params=how, dict_data=d)
            sizes.append(sum(len(c.compress(bytes(64) + raw[i : i + 4096])) for i in range(0, len(raw), 4096)))
        best, second = sorted(sizes)[:2]
        assert got[r["doc_id"]] == (model.languages[sizes.index(best)], second - best > max(0.05 * second, 2))


def test_language_of_ties_and_long_texts(spark):
    model = langid.Model(("b", "a"), (b" same words here ", b" same words here "))
    df = spark.createDataFrame([(1, "same words here"), (2, "same words here " * 200_000), (None, "same"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["lang_pred"], r["accepted"]) for r in langid.identify(df, model).collect()}
    assert got == {(1, "b", False), (2, "b", False), (None, "b", False), (3, "und", False)}
    assert langid.identify(df.limit(0), model).count() == langid.keep_identified(df.limit(0), model).count() == langid.keep_identified(df, model).count() == 0
    sure = langid.Model(("b", "a"), (b" same words here ", b" other things "))
    assert {r["doc_id"] for r in langid.keep_identified(df, sure).collect()} >= {1}


def invented(n, size=24):
    """Texts of n invented languages of 30 words each, which share none: (lang, text)."""
    rng = random.Random(7)
    for i in range(n):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)]
        for _ in range(3):
            yield f"l{i:03d}", " ".join(rng.sample(own, size))


def test_all_of_many_languages_are_learned(spark, monkeypatch):
    rows = list(invented(90))
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert sorted(model.languages) == sorted({lang for lang, _ in rows})
    assert [langid.predict(model, t)[0] for _, t in rows] == [lang for lang, _ in rows]
    assert sum(map(len, model.contents)) <= langid.LANGUAGES * langid.DICT_BYTES
    monkeypatch.setattr(langid, "MOST", 89)
    with pytest.raises(ValueError):
        langid.fit(df)


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = queries.toxicity_scores(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    order = held.score.rank()
    k = held.toxic.sum()
    auc = (order[held.toxic == 1].sum() - k * (k + 1) / 2) / (k * (len(held) - k))
    assert k > 50 and auc > 0.97 and ((held.predicted == 1) & (held.toxic == 0)).mean() < 0.01
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def plain_ftrl(texts, labels):
    """FTRL-proximal one coordinate at a time, in dictionaries: weights of features before calibration, intercept."""
    sets = []
    for t in texts:
        f, of = toxicity.features([t])
        sets.append(sorted({*f.tolist()}))
    l1 = min(max(min(sum(labels), len(labels) - sum(labels)) / toxicity.L1_TEXTS, toxicity.L1_RANGE[0]), toxicity.L1_RANGE[1])
    z, n = {}, {}

    def weight(f, bound):
        a = z.get(f, 0.0)
        return 0.0 if abs(a) <= bound else -(a - (bound if a > 0 else -bound)) / ((toxicity.BETA + n.get(f, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for own, y in zip(sets, labels, strict=True):
            w = {f: weight(f, l1) for f in own} | {-1: weight(-1, 0.0)}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for f, v in w.items():
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * v
                n[f] = old + g * g
    return {f: v for f in z if f >= 0 and (v := weight(f, l1))}, weight(-1, 0.0)


def test_toxicity_equals_plain_ftrl(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "calibrate", lambda model, *_: model)
    rng = random.Random(1)
    bad, good = "you awful rotten fool go away".split(), "a kind and quiet day by the sea".split()
    labels = [int(rng.random() < 0.4) for _ in range(120)]
    texts = [" ".join(rng.choice(bad + good if y else good) for _ in range(rng.randint(3, 20))) for y in labels]
    model, (weights, intercept) = toxicity.train(texts, labels, 0.4), plain_ftrl(texts, labels)
    assert model.intercept == pytest.approx(intercept, abs=1e-3)
    assert 5 < len(weights) < 3000 and model.features.tolist() == sorted(weights)
    assert model.weights == pytest.approx([weights[f] for f in sorted(weights)], abs=1e-3)
    # Scores are one sum over a text's distinct features.
    long = " ".join([*texts, *texts] * 300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "!!", None, long])], "doc_id long, text string")
    got = by_id(toxicity.score(df, model), "score")
    for i, t in enumerate([*texts, "", "!!", "", long]):
        own = {*toxicity.features([t])[0].tolist()}
        assert got[i][0] == pytest.approx(1 / (1 + np.exp(-(intercept + sum(weights.get(f, 0.0) for f in own)))), abs=2e-3)
    assert toxicity.score(df.limit(0), model).count() == toxicity.keep_clean(df.limit(0), model).count() == 0
    assert {r["doc_id"] for r in toxicity.keep_clean(df, model).collect()} == {i for i, x in got.items() if x[0] < 0.5}


def test_toxicity_features_are_words_pairs_triples_and_skips():
    for text in ("one two three four five", "a", "", "x y"):
        n = len(text.split())
        assert len(toxicity.features([text])[0]) == sum(max(n - k, 0) for k in (0, 1, 2, 2, 3))
    both, of = toxicity.features(["one two", "two one"])
    one = lambda t: sorted(toxicity.features([t])[0].tolist())
    assert sorted(both[of == 0].tolist()) == one("ONE two!") != one("two one") == sorted(both[of == 1].tolist())


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (5, 0), (8, 1), (10, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = by_id(toxicity.score(odd, model), "score", "predicted")
    assert got[0] == got[1] == got[2] and all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert by_id(toxicity.score(odd, toxicity.fit(odd, labels.limit(0))), "predicted")[5] == (0,)


def test_toxicity_trains_beside_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 6400)
    rows = [(i, "long text " * 700 if i < 20 else "you awful fool" if i % 2 else "kind good day", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).intercept != toxicity.Model().intercept


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    own, said = queries.QUERIES[name](spark, DIR).toPandas(), c.execute(queries.ORACLES[name]).df()
    text = lambda df: sorted(tuple("" if v is None else str(v) for v in r) for r in df[sorted(own.columns)].itertuples(index=False))
    assert sorted(own.columns) == sorted(said.columns) and text(own) == text(said)


@pytest.mark.parametrize("limit", [1, 40, 300, 5000, 10**9])
def test_shards(spark, odd, docs, limit):
    for df in (odd, docs.limit(80)):
        rows = sharding.assign(df, limit).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
        sizes, most = Counter(), {}
        for r in rows:
            k = (r["depth"], r["prefix"], r["part"])
            sizes[k] += r["bytes"]
            most[k] = max(most.get(k, 0), r["bytes"])
        assert all(n <= limit or n == most[k] for k, n in sizes.items())
        deep = {(r["depth"], r["prefix"]) for r in rows}
        assert not any((d2 < d1 and p1 >> (d1 - d2) == p2) for d1, p1 in deep for d2, p2 in deep)
    assert sharding.assign(odd.limit(0), limit).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "http://b.example.net/de", "http://example.com/de/x", "http://example.com/DE/x", "http://x.org/fr/", "http://net/", "http://net", "no url", None, "x://h?q/", "ftp://notexample.com/de/", "HTTP://É.Org/fr/é"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://net/", None), (1, urls[1], None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(9, 0, 0), (9, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = urlfilter.judge(pages, urlfilter.outcomes(labels)).collect()
    assert len(rows) == len(urls) + 2
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("b.example.net", "/de", "net/", "block")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2] is None
    assert got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("net/", "block")
    assert got[6][:3] == ("net", "", None) and got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][:3] == ("h", "", None) and got[10][2] is None and got[11][0] == "É.org"
    assert urlfilter.judge(pages.limit(0), urlfilter.outcomes(labels)).count() == 0


def test_reputation_shrinks(spark):
    rows = [("a.x.com", 1)] * 40 + [("b.x.com", 1)] + [(f"c{i}.y.com", 0) for i in range(40)] + [("d.x.com", None)]
    got = {r["host"]: r["bound"] for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.com"] > urlfilter.LIMIT > got["c1.y.com"]
    assert got["a.x.com"] > got["b.x.com"] > got["d.x.com"] > got["c1.y.com"]


def test_sites(spark):
    want = {
        "www.a.co.uk": ("a.co.uk", "co.uk"), "a.co.uk:8080": ("a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.b.com.au": ("b.com.au", "com.au"), "a.example.com:80": ("example.com", "com"),
        "example.org": ("example.org", "org"), "net": ("net", "net"), "": ("", ""), "10.0.0.1:99": ("10.0.0.1", "10.0.0.1"), "me:pw@w.a.co.uk:1": ("a.co.uk", "co.uk"), "@": ("", ""), "[::1]:80": ("[::1]", "[::1]"), "1.2.3": ("2.3", "3"),
    }
    domain, suffix = urlfilter._site()
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == want
    rows = [("a.bad.co.uk", 1)] * 40 + [(f"s{i}.site{i}.co.uk", 0) for i in range(40)] + [("b.bad.co.uk", None), ("b.good.co.uk", None)]
    bound = {r["host"]: r["bound"] for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert bound["b.bad.co.uk"] > bound["b.good.co.uk"]


def test_many_rules_equal_one_expression(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "co", "net"])
    rules = sorted({(".".join(label() for _ in range(rng.randint(1, 3))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(120)})
    rules = [*{r[:2]: r for r in rules}.values()]
    rows = [(i, ".".join(label() for _ in range(rng.randint(0, 4))), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))) for i in range(600)]
    df = spark.createDataFrame([*rows, (600, "", "")], "i int, host string, path string")
    one, joined = ([tuple(r) for r in urlfilter.ruled(df, rules, chain).orderBy("i").select("i", "host", "path", "rule", "said").collect()] for chain in (500, 0))
    assert one == joined and len({r[3] for r in one}) > 30
    assert urlfilter.ruled(df, rules, 0).columns == ["i", "host", "path", "rule", "said"]


def test_reputation_reads_pages_few_times(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    plan = urlfilter.judge(pages, urlfilter.outcomes(spark.read.parquet(f"{DIR}/labels.parquet")))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= sum("Relation" in line and "url#" in line for line in plan.splitlines()) <= 3


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_hot_keys_are_joined_alike(spark, share):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 20}" if i % 5 else None) for i in range(200)], "i int, key string")
    unique = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = {(r["i"], r["key"], r["n"], r["least"]) for r in util.joined(rows, unique, "key", "n", 200, share).collect()}
    assert got == {(r["i"], r["key"], r["n"], r["least"]) for r in rows.join(unique, "key").collect()} and len(got) > 150


def test_kept_tables(spark, tmp_path, monkeypatch):
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "yarn"
            getConf = staticmethod(lambda: {})  # noqa: N815

    with pytest.raises(RuntimeError):
        util.shared_top(Elsewhere)
    monkeypatch.setattr(util, "shared_top", lambda _: f"file://{tmp_path}")
    df = util.keep(spark.range(5).toDF("id"), "five")
    assert df.count() == 5 and len(list((tmp_path / util.KEPT).iterdir())) == 1
    (tmp_path / "other").mkdir()
    util.clear(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_pipeline_of_empty_and_odd_tables(spark, odd, tmp_path):
    plain = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(5, 0, 0), (8, 1, 0), (None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", plain.limit(0)), ("odd", plain)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{name}").count() <= docs.count()
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        packed_right(out, queries.CAPACITY)
        assert (len(out) > 0) == (name == "odd")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == docs.columns
        assert 0.7 * docs.count() < kept.count() <= docs.count(), name
    out = corpus_pipeline.run(spark, DIR)
    packed_right(out.collect(), queries.CAPACITY)
    assert {"pipeline", *queries.QUERIES} <= {*entry.queries()} and entry.oracle_sql().keys() <= entry.queries().keys()


def test_pipeline_equals_plain_python(spark, docs):
    from tokenizers import Tokenizer

    rows = docs.select("doc_id", "text").collect()
    frame = lambda rows: docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    clean = [r for r in rows if toxicity.scores(model, [r["text"]])[0] < corpus_pipeline.TOXIC]
    known = langid.fit(frame(clean))
    told = [r for r in clean if langid.predict(known, r["text"])[2]]
    sets = neardup._sets([r["text"] for r in told], neardup.frequent(frame(told).select("text"), len(told)))
    pairs = [(a["doc_id"], told[j]["doc_id"]) for i, a in enumerate(told) for j in range(i) if a["text"] == told[j]["text"] or neardup.jaccard(sets[i], sets[j]) >= neardup.THRESHOLD]
    one = {*closure(pairs, [r["doc_id"] for r in told]).values()}
    assert 0 < len(one) < len(told) < len(clean) < len(rows)
    lib = Tokenizer.from_file(BPE)
    want = Counter()
    for r in told:
        if r["doc_id"] in one:
            ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), queries.CAPACITY):
                piece = ids[k : k + queries.CAPACITY]
                want[r["doc_id"], k // queries.CAPACITY, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, DIR).collect()
    packed_right(out, queries.CAPACITY)
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
