"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token starts as a linked list of bytes. A bucket per merge rank holds
the positions at which that merge could happen; a bitmap of two levels marks
the ranks whose buckets are not empty, so the next merge is two find-first-set
steps away whatever the length. A position whose pair has changed since it was
queued is stale and is skipped. The work is close to linear in the length, so
one pre-token of megabytes is no special case.

Cases: a null or empty text has no tokens; rows are encoded one by one, so
repeated rows get equal results; very long texts are encoded whole; of equal
ranks in a pre-token the leftmost is merged first; an empty table gives an empty result; other
columns pass through unless their name is one of the results'. No string is
treated as a special token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import bound_arrow, lent, tidy

#: Bits of a word of the bitmap's lower level.
_WORD = 512
#: Pre-tokens after which a worker's cache of ids starts anew, and the longest pre-token kept in it.
CACHE = 500_000
CACHE_CHARS = 40
#: Pre-tokens that are looked up together.
_GROUP = 100_000


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.byte_pair = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.packed = {piece: int(rank).to_bytes(4, "little") for piece, rank in self.ranks.items()}
        self.bitmap_words = max(self.pieces) // _WORD + 1
        #: Bits of an id: a pair of ids is one number, with the left one above these bits.
        self.shift = max(self.pieces).bit_length()
        #: Rank of the piece that two pieces make, by that number.
        self.pair_rank: dict[int, int] = {}
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if left is not None and right is not None:
                    self.pair_rank[left << self.shift | right] = rank
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each of some pre-tokens, merged together under one queue.

        Pre-tokens are runs of one linked list with no pair across their ends.
        The least rank of all is the least rank of each run that has it, so
        every run sees its own merges in order.
        """
        raw = b"".join(pieces)
        n = len(raw)
        if not n:
            return [[] for _ in pieces]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        byte = np.frombuffer(raw, np.uint8).astype(np.int64)
        first = np.full(n, -1, np.int64)
        first[:-1] = self.byte_pair[byte[:-1] * 256 + byte[1:]]
        first[ends[ends > 0] - 1] = -1
        ids = self.byte_ids[byte].tolist()
        wanted = first.tolist()
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        last = np.zeros(n + 1, bool)  # no pair begins before one of these
        last[ends] = True
        stop = last.tolist()

        # The queue: positions by rank under a bitmap of two levels.
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranks, at = np.unique(first[order], return_index=True)
        buckets = {r: list(x) for r, x in zip(ranks.tolist(), np.split(order, at[1:]), strict=True)} if len(ranks) else {}
        buckets = {r: [int(i) for i in x] for r, x in buckets.items()}
        low = [0] * self.bitmap_words
        top = 0
        for rank in buckets:
            low[rank // _WORD] |= 1 << rank % _WORD
            top |= 1 << rank // _WORD
        pair_rank, shift = self.pair_rank.get, self.shift
        bucket_of = buckets.get

        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            bit = (bits & -bits).bit_length() - 1
            low[word] = bits ^ (1 << bit)
            if not low[word]:
                top ^= 1 << word
            rank = word * _WORD + bit
            positions = buckets.pop(rank)
            positions.sort()
            for i in positions:
                if wanted[i] != rank:
                    continue  # stale: the pair here was merged away or has changed
                j = after[i]
                k = after[j]
                ids[i] = rank
                ids[j] = -1
                wanted[j] = -1
                after[i] = k
                if k < n:
                    before[k] = i
                for left, right in ((i, k), (before[i], i)):
                    if left < 0:
                        continue
                    if stop[right]:
                        wanted[left] = -1
                        continue
                    wanted[left] = new = pair_rank(ids[left] << shift | ids[right], -1)
                    if new >= 0:
                        bucket = bucket_of(new)
                        if bucket is None:
                            buckets[new] = [left]
                            low[new // _WORD] |= 1 << new % _WORD
                            top |= 1 << new // _WORD
                        else:
                            bucket.append(left)

        kept = np.array(ids, np.int64)
        live = np.flatnonzero(kept >= 0)
        return [x.tolist() for x in np.split(kept[live], np.searchsorted(live, ends[:-1]))]

    def _learn(self, found: list[str]) -> dict[str, bytes]:
        """Packed ids of the pre-tokens that the cache lacks; short ones are kept there."""
        cache, known = self.cache, self.packed
        if len(cache) > CACHE:
            cache.clear()
        lacking = [p for p in dict.fromkeys(found) if p not in cache]
        fresh, raws = {}, []
        for piece in lacking:
            raw = piece.encode("utf-8")
            packed = known.get(raw)
            if packed is None:
                raws.append((piece, raw))
            else:
                fresh[piece] = packed
        for (piece, _), ids in zip(raws, self.merge([raw for _, raw in raws]), strict=True):
            fresh[piece] = np.array(ids, "<u4").tobytes()
        cache.update((p, x) for p, x in fresh.items() if len(p) <= CACHE_CHARS)
        return fresh

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for number, text in enumerate(texts, 1):
            pieces = self.split(text)
            group.append(pieces)
            size += len(pieces)
            if size >= _GROUP or number == len(texts):
                fresh = self._learn([p for x in group for p in x])
                cache = self.cache.get
                out.extend(b"".join([cache(p) or fresh[p] for p in x]) for x in group)
                group, size = [], 0
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBPE] = {}  # kept between tasks: most pre-tokens come again; but not for other stages


def codec(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The worker's encoder for a rank file, made once."""
    import public_tokenizers

    key = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if key not in _loaded:
        _loaded[key] = ByteBPE(*key)
    return _loaded[key]


@contextmanager
def lent_codec(path: str | None = None, pattern: str | None = None) -> Iterator[ByteBPE]:
    """The worker's encoder for a task; here, not in the task, as a task's own names are copies."""
    with lent(_loaded):
        yield codec(path, pattern)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Ids of each text (``ids``), their number, and digests of the ids and of the bytes decoded from them.

    ``keep``: the columns to pass through, all but the text by default.
    """
    names = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    bound_arrow(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, *names)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    schema = ", ".join([*fields, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent_codec(path, pattern) as own:
            yield from encoded(own, batches)

    def encoded(own: ByteBPE, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = own.encode_all([x or "" for x in batch.column(len(keep)).to_pylist()])
            decoded = [hashlib.sha256(own.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in packed]
            counts = np.array([len(x) // 4 for x in packed], np.int64)
            flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat)
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts), lists, digests, pa.array(decoded, pa.string())], names=[*keep, *names])

    return source.mapInArrow(tidy(run), schema)
