"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens; each is segmented into the pieces of a public
vocabulary with the greatest sum of log-probabilities. Distinct pre-tokens go
into a trie, and the forward score and piece count of a prefix are computed
once at its node, from the nodes above it; a pre-token's count stands at its
last node. Probabilities follow Zipf's law over the vocabulary's ranks.

The trie belongs to a worker, lives across batches and starts anew beyond
``MOST_NODES``, so its memory is bounded whatever the corpus. Pre-tokens
longer than ``MOST_DEPTH`` bytes run through the same recurrence without
being inserted. There is no shuffle.

Cases: a null or empty text has no pre-tokens and no tokens; very long texts are
counted whole; repeated rows get equal results; ties between segmentations go to the one with fewer pieces; an
empty table gives an empty result; other columns pass through unless their
name is one of the results'.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import bound_arrow, dropped_at_end, tidy

MOST_NODES = 600_000
MOST_DEPTH = 128
#: Shift of the rank in Zipf's law.
ZIPF_SHIFT = 2.7


def rank_scores(path: str) -> dict[bytes, float]:
    """Log-probability of each piece of a rank file."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    total = math.log(math.fsum(1 / (r + ZIPF_SHIFT) for r in ranks.values()))
    return {piece: -math.log(rank + ZIPF_SHIFT) - total for piece, rank in ranks.items()}


class CountingTrie:
    """Trie of pre-tokens with the best segmentation of every prefix."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        #: Score of each piece; None for a proper suffix of a piece that is no piece.
        self.suffixes: dict[bytes, float | None] = {}
        for piece, score in scores.items():
            self.suffixes[piece] = score
            for k in range(1, len(piece)):
                self.suffixes.setdefault(piece[k:], None)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def _extend(self, path: bytes, depth: int, above: list[float], counts: list[int]) -> tuple[float, int]:
        """Best score and count of ``path[:depth]`` from those of all shorter prefixes."""
        suffixes, best, fewest = self.suffixes, -math.inf, 0
        for begin in range(depth - 1, -1, -1):
            found = suffixes.get(path[begin:depth], 0.0)
            if found == 0.0:
                break
            if found is not None:
                score = above[begin] + found
                if score > best or (score == best and counts[begin] + 1 < fewest):
                    best, fewest = score, counts[begin] + 1
        return best, fewest

    def tokens(self, token: bytes) -> int:
        """Pieces in the best segmentation of a pre-token."""
        scores, counts = [0.0], [0]
        if len(token) > MOST_DEPTH:
            for depth in range(1, len(token) + 1):
                score, count = self._extend(token, depth, scores, counts)
                scores.append(score)
                counts.append(count)
            return counts[-1]
        if len(self.score) > MOST_NODES:
            self.clear()
        node, child = 0, self.child
        for depth, byte in enumerate(token, 1):
            edge = node << 8 | byte
            node = child.get(edge, -1)
            if node < 0:
                score, count = self._extend(token, depth, scores, counts)
                node = child[edge] = len(self.score)
                self.score.append(score)
                self.count.append(count)
            scores.append(self.score[node])
            counts.append(self.count[node])
        return counts[-1]


_loaded: dict[tuple[str, str], tuple] = dropped_at_end({})


def _worker(path: str | None, pattern: str | None):
    import public_tokenizers
    import regex

    key = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if key not in _loaded:
        _loaded[key] = regex.compile(key[1]).findall, CountingTrie(rank_scores(key[0])), {}
    return _loaded[key]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``n_pretokens`` and ``n_tokens`` of each text; ``keep`` names the columns to pass through (all but the text by default)."""
    names = ["n_pretokens", "n_tokens"]
    bound_arrow(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, *names)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "n_pretokens long, n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, trie, known = _worker(path, pattern)
        for batch in batches:
            pieces, tokens = [], []
            for value in batch.column(len(keep)).to_pylist():
                found = split(value or "")
                if len(known) > MOST_NODES:
                    known.clear()
                for piece in set(found).difference(known):
                    known[piece] = trie.tokens(piece.encode("utf-8"))
                pieces.append(len(found))
                tokens.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, *names])

    return source.mapInArrow(tidy(run), schema)
