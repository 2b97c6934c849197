"""Token counts by dynamic programming shared along a trie.

A unigram model over a public vocabulary splits each pre-token (a blank-separated word with the word-start
mark in front) into the pieces with the greatest sum of scores.  The best score of a prefix depends on the
prefix alone, so the distinct pre-tokens are inserted in a trie: a node is solved when it is made, from the
nodes above it, and holds the best score of its prefix and the pieces that it takes.  The node at which a
pre-token ends is its count.  A worker's trie serves all its batches until it has ``NODES`` nodes; a pre-token
of more than ``LONG`` characters shares next to nothing and is solved along a window of the longest piece.

Scores are a parameter (a score for each piece).  Without one the vocabulary file's order is used: it holds no
probabilities, and tokenizers are not trained here, so piece number r has the Zipf probability
1 / (r + 1) / H, in whole micro-nats (ties are then exact; they go to fewer pieces).  Characters outside the
vocabulary fall back to their UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .shingles import slices

MARK = "▁"
#: Nodes of a trie before it begins anew, and counts that a worker remembers; they bound memory and change no result.
NODES, REMEMBER = 300_000, 200_000
#: Characters of a pre-token that is inserted; longer ones are neither inserted nor remembered, to the same count.
LONG = 4096


def default_vocabulary() -> str:
    """The path of the installed public vocabulary; operators take another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def load_scores(path: str) -> tuple[dict[str, int], list[int], frozenset[str], int]:
    """(score of each piece, scores of the 256 bytes, all suffixes of pieces, longest piece)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / (r + 1) for r in range(n)))
    order = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    score = lambda r: -round(1e6 * (math.log(r + 1) + total))
    pieces = {model.id_to_piece(i): score(r) for r, i in enumerate(order)}
    octets = [score(len(order) + b) for b in range(256)]  # bytes rank after all pieces
    ends = frozenset(p[k:] for p in pieces for k in range(len(p)))
    return pieces, octets, ends, max(map(len, pieces))


class Trie:
    """Prefixes of the words inserted so far, each solved once."""

    def __init__(self, pieces: dict[str, int], octets: list[int], ends: frozenset[str]):
        self.pieces, self.octets, self.ends = pieces, octets, ends
        self.below: dict[tuple[int, str], int] = {}
        self.best, self.count = [0], [0]

    def insert(self, word: str) -> int:
        """Pieces in the best split of ``word``: the count that its last node holds."""
        below, node = self.below, 0
        path = [0]
        for d, c in enumerate(word):
            nxt = below.get((node, c))
            if nxt is None:
                nxt = below[(node, c)] = self._solve(word, d + 1, path)
            path.append(nxt)
            node = nxt
        return self.count[node]

    def _solve(self, word: str, d: int, path: list[int]) -> int:
        """A node for word[:d], from the nodes of its prefixes."""
        best, count, get = self.best, self.count, self.pieces.get
        raw = word[d - 1].encode("utf-8", "surrogatepass")
        if word[d - 1] in self.pieces:
            s, n = -(1 << 62), 0
        else:
            s, n = best[path[d - 1]] + sum(self.octets[x] for x in raw), count[path[d - 1]] + len(raw)
        a = d - 1
        while a >= 0 and (p := word[a:d]) in self.ends:  # beyond that no piece ends here
            v = get(p)
            if v is not None:
                t, k = best[path[a]] + v, count[path[a]] + 1
                if t > s or (t == s and k < n):
                    s, n = t, k
            a -= 1
        best.append(s)
        count.append(n)
        return len(best) - 1


def windowed(word: str, pieces: dict[str, int], octets: list[int], ends: frozenset[str], longest: int) -> int:
    """``Trie.insert`` without a trie: only the prefixes that the longest piece can reach are kept."""
    size = max(1, longest) + 1
    best, count, get = [0] * size, [0] * size, pieces.get
    for d in range(1, len(word) + 1):
        c, before = word[d - 1], (d - 1) % size
        if c in pieces:
            s, n = -(1 << 62), 0
        else:
            raw = c.encode("utf-8", "surrogatepass")
            s, n = best[before] + sum(octets[x] for x in raw), count[before] + len(raw)
        a = d - 1
        while a >= 0 and (p := word[a:d]) in ends:
            v = get(p)
            if v is not None:
                t, k = best[a % size] + v, count[a % size] + 1
                if t > s or (t == s and k < n):
                    s, n = t, k
            a -= 1
        best[d % size], count[d % size] = s, n
    return count[len(word) % size]


def scored(scores: dict[str, int]) -> tuple[dict[str, int], list[int], frozenset[str], int]:
    """A parameter table of piece scores as ``load_scores`` returns it; bytes score below every piece."""
    least = min(scores.values(), default=0)
    ends = frozenset(p[k:] for p in scores for k in range(len(p)))
    return dict(scores), [least - 1_000_000] * 256, ends, max(map(len, scores), default=0)


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, int] | None = None) -> DataFrame:
    """``docs``' ids with n_words and n_tokens.  Null texts have null counts, texts without words 0.

    Nothing is shuffled: each worker has its own trie, and a pre-token is solved once however often it
    occurs in a batch.  Texts are read whole, with words of any length.  ``scores``: pieces (with the
    word-start mark) and their scores as whole numbers, in place of those of the vocabulary file.  An id column
    that is called like one of the counts comes out as ``id``.
    """
    path = None if scores is not None else vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, octets, ends, longest = scored(scores) if path is None else load_scores(path)
        trie, known = Trie(pieces, octets, ends), {}
        for b in batches:
            for part in slices(b, 1):
                words = [t.as_buffer().to_pybytes().split() if t.is_valid else None for t in part.column(1)]
                if len(known) > REMEMBER:
                    known.clear()
                once = {}
                for w in set().union(*(w for w in words if w)).difference(known):
                    if len(w) > LONG:
                        once[w] = windowed(MARK + w.decode("utf-8", "replace"), pieces, octets, ends, longest)
                        continue
                    if len(trie.best) > NODES:
                        trie = Trie(pieces, octets, ends)
                    known[w] = trie.insert(MARK + w.decode("utf-8", "replace"))
                n = [None if w is None else len(w) for w in words]
                at = (lambda w: once[w] if len(w) > LONG else known[w]) if once else known.__getitem__
                t = [None if w is None else sum(map(at, w)) for w in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(t, pa.int64())], [name, "n_words", "n_tokens"])

    name = "id" if id_col.lower() in ("n_words", "n_tokens") else id_col
    return mapped(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), run, f"`{name}` {docs.select(F.col(f'`{id_col}`')).schema[0].dataType.simpleString()}, n_words long, n_tokens long")
