"""Word-piece token counts by a linear longest-match automaton.

Two tries share one table of moves: pieces that begin a word and pieces that continue one. Where no move
fits, a failure link drops the longest pieces that are certain and goes on behind them; how many those are is
computed beforehand, so a word is read once, letter by letter, and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from barlens.llm.util import slices

#: Distinct words that a worker remembers, and characters of them; beyond either the memory is emptied.
REMEMBERED, REMEMBERED_CHARS = 400_000, 16 << 20

_WORDS = regex.compile(r"[^\p{White_Space}\p{P}$+<=>^`|~]+|[\p{P}$+<=>^`|~]")
_SIMPLE = regex.compile(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]")


def words(text: str) -> list[str]:
    """Runs between white space, punctuation marks by themselves; case and accents stay."""
    return (_SIMPLE if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else _WORDS).findall(text)


class Automaton:
    """Greedy longest-match piece counts for a set of first pieces and of continuing pieces."""

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.move: dict[tuple[int, str], int] = {}
        child: list[list[tuple[str, int]]] = [[], []]  # nodes 0 and 1 are the roots
        final = {*()}
        for root, vocab in enumerate((first, later)):
            for piece in vocab:
                u = root
                for c in piece:
                    if (u, c) not in self.move:
                        self.move[u, c] = len(child)
                        child[u].append((c, len(child)))
                        child.append([])
                    u = self.move[u, c]
                if piece:
                    final.add(u)
        #: Where to go on when no move fits (-1: the word can't be cut), and how many pieces end there.
        self.fail, self.pops = [-1] * len(child), [0] * len(child)
        queue = [0, 1]
        for u in queue:
            for c, v in child[u]:
                queue.append(v)
                if v in final:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and (z, c) not in self.move:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.move[z, c], n
        self.known: dict[str, int] = {}
        self.chars = 0

    def count(self, word: str) -> int:
        """The number of pieces of a word; -1 where it can't be cut into pieces."""
        move, fail, pops = self.move, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := move.get((u, c))) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n

    def counts(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text; an unknown word is one token."""
        many = words(text) if text else []
        known = self.known
        if len(known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            known.clear()
            self.chars = 0
        for w in {*many}.difference(known):
            known[w] = self.count(w)
            self.chars += len(w)
        each = list(map(known.__getitem__, many))
        unknown = each.count(-1)
        return len(many), sum(each) + 2 * unknown, unknown


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """The automaton of a sentencepiece model: pieces with the mark of a word's start, and the others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return Automaton([p[1:] for p in own if p[0] == "▁"], [p for p in own if p[0] != "▁"])


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the pieces of every text: (id, n_words, n_tokens, n_unknown), one row per row of `df`.

    A null or empty text has no words and no tokens; repeated rows and null ids give rows of their own; other
    columns are not read. Words have no length limit.
    """

    def run(batches):
        automaton = load(path)
        for batch in batches:
            for part in slices(batch):
                cols = zip(*[automaton.counts(t) for t in part.column("text").to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(df.dtypes)[id_col]
    return df.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
