"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round finds, for every word, its pair of lowest
rank (a binary search of the pair keys in the sorted keys of all merges), merges the places of that pair
and looks up only the pairs that are new. Words are encoded once and remembered, up to a fixed count and size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barlens.llm.util import slices

#: Distinct words that a worker remembers, and characters of them; beyond twice either the older half goes.
REMEMBERED, REMEMBERED_CHARS = 150_000, 4 << 20

# Fixed values of the format: which characters stand for bytes that have none of their own.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

_SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_FULL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_LAST = 1 << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary."""
    out, extra = {}, 0
    for b in range(256):
        if b in _PRINTABLE:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class BPE:
    """A word-end BPE vocabulary: lower case, white space dropped, ids as the tokenizers library gives them."""

    def __init__(self, path: str):
        data = json.loads(Path(path).read_text("utf-8"))
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        end = data["model"]["end_of_word_suffix"]
        self.size = 1 + max(vocab.values())
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.token = [""] * max(self.size, 1 + max(self.special.values(), default=0))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.young: list[dict] = [{}, {}]  # without and with texts
        self.old: list[dict] = [{}, {}]
        self.chars = [0, 0]  # of the young words

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and place of each pair in one number; pairs that don't merge get _LAST."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, (self.rank[at] << 20) | at, _LAST)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian unsigned 32-bit numbers."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.final[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), _LAST)
        rank[:-1] = self._ranks(ids[:-1], ids[1:])
        rank[ends] = _LAST
        out = [b""] * len(words)
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            counts = np.diff(starts, append=len(ids))
            least = np.minimum.reduceat(rank, starts)
            done = least == _LAST
            if done.any():
                stay = np.repeat(~done, counts)
                raw, at = ids[~stay].astype("<u4").tobytes(), 0
                for w, n in zip(owner[starts[done]].tolist(), (4 * counts[done]).tolist(), strict=True):
                    out[w] = raw[at : at + n]
                    at += n
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                least, counts = least[~done], counts[~done]
                if not len(ids):
                    break
            hit = rank == np.repeat(least, counts)
            at = np.flatnonzero(hit)
            # A symbol belongs to one pair only: in runs such as a a a every second place counts, from the left.
            begin = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
            at = at[place % 2 == 0]
            ids[at] = self.made[rank[at] & 0xFFFFF]
            rank[at] = rank[at + 1]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            at = at - np.arange(len(at))
            new = np.zeros(len(ids), bool)
            new[at] = new[at[at > 0] - 1] = True
            new = np.flatnonzero(new[:-1] & (owner[:-1] == owner[1:]))
            rank[new] = self._ranks(ids[new], ids[new + 1])
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens among them."""
        if self.cut and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    @staticmethod
    def _words(text: str) -> list[str]:
        try:
            text.encode("latin-1")  # such text is its own NFC
        except UnicodeEncodeError:
            # lower() knows the final sigma, which a letter-by-letter mapping doesn't
            return _FULL.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return _SIMPLE.findall(text.lower())

    def learn(self, words: set[str], text: bool = False) -> dict:
        """What is remembered of each of these words: its ids as bytes, or with `text` (count, ids as text, tokens as text)."""
        young, old = self.young[text], self.old[text]
        missing = words.difference(young)
        self.chars[text] += sum(map(len, missing))
        for w in missing.intersection(old):
            young[w] = old[w]
        missing = missing.difference(young)
        for w in missing.intersection(self.special):
            young[w] = self._entry(np.uint32(self.special[w]).tobytes(), text)
        plain = list(missing.difference(self.special))
        for lo in range(0, len(plain), 20_000):
            part = plain[lo : lo + 20_000]
            made = self.merge(part)
            young.update(zip(part, [self._entry(x, True) for x in made] if text else made, strict=True))
        if len(young) > REMEMBERED or self.chars[text] > REMEMBERED_CHARS:
            self.old[text], self.young[text], self.chars[text] = young, {}, 0
        return young

    def _entry(self, ids: bytes, text: bool) -> bytes | tuple[int, str, str]:
        if not text:
            return ids
        many = memoryview(ids).cast("I").tolist()
        return len(many), " ".join(map(str, many)), " ".join([self.token[i] for i in many])

    def words(self, texts: list[str | None], text: bool = False) -> tuple[list[list[str]], dict]:
        """The words of each text, and what is remembered of them; a null counts as empty."""
        words = [self.pieces(t) if t else [] for t in texts]
        return words, self.learn(set().union(*words), text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        words, known = self.words(texts)
        return [b"".join(map(known.__getitem__, x)) for x in words]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space, as the library does for a file without a decoder; unknown ids vanish."""
        return " ".join([self.token[i] for i in ids if 0 <= i < len(self.token) and self.token[i]])


@lru_cache(maxsize=2)
def load(path: str) -> BPE:
    """The vocabulary at `path`, once per process."""
    return BPE(path)


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256), one row per row of `df`.

    A null text counts as empty (no tokens, digests of the empty string); repeated rows and null ids give
    rows of their own; other columns are not read. Memory: one slice of texts and the remembered words.
    """
    from hashlib import sha256

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                words, known = bpe.words(part.column("text").to_pylist(), text=True)
                found = [[known[w] for w in x] for x in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([sum([e[0] for e in x]) for x in found], pa.int64()),
                        pa.array([sha256(" ".join([e[1] for e in x]).encode()).hexdigest() for x in found]),
                        pa.array([sha256(" ".join([e[2] for e in x]).encode()).hexdigest() for x in found]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_table(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: (id, ids array<int>); the same rules as `digest`."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(x, "<i4") for x in bpe.encode_batch(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_table(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The way back: (id, text) from a column of ids; null ids give the empty text."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([bpe.decode([i for i in x or [] if i is not None]) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids").mapInArrow(run, f"doc_id {kind}, text string")
