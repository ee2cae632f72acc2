"""Token counts by linear longest match (Song et al., "Fast WordPiece Tokenization", 2021).

The vocabulary is a trie with two roots, for word starts and for continuations. Each node has a failure
link and the number of pieces that following it pops, so that a word's greedy longest-match length comes
from one pass over its characters; no piece is built.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of word characters, or one other character that isn't blank.
WORD = re.compile(r"\w+|[^\w\s]")
#: Counts of so many words are kept in a worker before it starts afresh; this bounds memory, not results.
CACHE = 400_000


class Automaton:
    """Lengths of greedy word-piece segmentations; a word that the vocabulary can't spell has length 1 (unknown)."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.goto[node]:
                        self.goto[node][c] = len(self.goto)
                        self.goto.append({})
                        final.append(False)
                    node = self.goto[node][c]
                final[node] = node > 1
        self.fail = [-1] * len(self.goto)
        self.pops = [0] * len(self.goto)
        queue = [(0, c, v) for c, v in self.goto[0].items()] + [(1, c, v) for c, v in self.goto[1].items()]
        for u, c, v in queue:  # breadth first, for it grows meanwhile
            if final[v]:
                self.fail[v], self.pops[v] = 1, 1
            else:
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.goto[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.goto[z][c], n
            queue += [(v, d, w) for d, w in self.goto[v].items()]

    def length(self, word: str) -> int:
        goto, fail, pops = self.goto, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := goto[u].get(c)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


def piece_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Word starts and continuations of a sentencepiece model's vocabulary; byte and control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


_LOADED: dict[str, tuple[Automaton, dict[str, int]]] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens)`` of every text under the vocabulary file at ``vocabulary`` (on every machine).

    Null and empty texts have 0 of both. Row by row: repeated rows and null ids stay as they are; other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = Automaton(*piece_vocabulary(vocabulary)), {}
        automaton, known = _LOADED[vocabulary]
        for batch in batches:
            n_words, n_tokens = [], []
            for x in batch.column(1):
                words = WORD.findall(x.as_py() or "")
                lengths = list(map(known.get, words, repeat(0)))
                total = sum(lengths)
                if 0 in lengths:
                    for w, n in zip(words, lengths, strict=True):
                        if not n:
                            if (n := known.get(w)) is None:
                                n = known[w] = automaton.length(w)
                            total += n
                    if len(known) > CACHE:
                        known.clear()
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
