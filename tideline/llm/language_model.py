"""Interpolated modified Kneser-Ney model of order 2 or 3: counted in Spark, stored as sorted arrays, mapped by workers.

Words are counted first; their sorted hashes are the vocabulary, and a word's
id is its place there. Bigrams are counted next as two ids packed in 64 bits;
a one-to-one mix of the packed ids is their hash, so nothing collides and the
hash ranges that they are dealt by are even, however frequent one word or pair
is. Tasks send sorted arrays that they have already summed up, not rows. Each
hash range becomes one shard of sorted arrays in the shared folder. The same
tasks sum up, per word, how many words follow it once, twice or more often and
how many precede it; these go into shards by ranges of ids. The driver sees
the shards' names and a few sums, never their contents.

At order 3 a bigram's number is its place in the bigram table, and a trigram is
the number of its first two words' bigram and the id of its third, in 64 bits,
again without collisions. Where two numbers need more than 64 bits, a key is a
complex number that holds both. Each bigram has its followers seen once, twice and
more often, and counts by how many distinct words precede it, which is in how many
trigrams it comes last; the texts are not read again for that (at a text's start,
where nothing precedes, it counts by how often it occurs). Sorted runs go through the
shared folder and are deleted as soon as they are merged, and trigrams and what they
end in are counted in passes by ranges of bigrams, so a run's disk is reused.

Workers map the arrays and look up the sorted distinct keys of a batch. An
estimate has the modified discounts (for counts of 1, 2, and 3 or more) and is
interpolated with the estimate by one word less of context, the last of these
with the continuation estimate of the word, and that with the uniform
distribution over the vocabulary and one unknown word.

Cases: a null or empty text is one end token; very long texts are counted and
scored whole; a null id is hashed as an empty string, and a row for which
``held_out`` is null is trained on; repeated rows get equal results and count
as often as they occur, and there are no ties to settle; with no training rows
every token is unknown; an empty table gives an empty result, which has no
columns of the input but the key.
"""

from __future__ import annotations

import ast
import mmap
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.store import Files, bound_arrow, delete_folder, discard, materialize, new_folder, shuffle_partitions, tidy
from tideline.llm.words import mix, slices, words_of

U64 = np.uint64
#: The token that ends a text; also the context of its first word.
END = mix(np.array([0x0E4D], U64))[0]
#: Keys that a task holds before it sends them on.
MOST_KEYS = 2_500_000
#: Bytes of text that are worked on together: the more, the fewer distinct keys are looked up per token.
PIECE = 4 << 20
#: Training tokens per shard at most, on average, as a task merges a shard in memory.
SHARD_TOKENS = 8_000_000
#: Passes in which trigrams are counted over the texts, and bigrams' predecessors over the trigrams.
PASSES = 3
#: Bits up to which two numbers are one key; beyond, a key is a pair of them.
KEY_BITS = 64


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, an end token after each, and where each text's tokens begin."""
    words = words_of(column)
    ends = words.first[1:] + np.arange(1, words.n_docs + 1)
    out = np.empty(len(words.start) + words.n_docs, U64)
    is_word = np.ones(len(out), bool)
    is_word[ends - 1] = False
    out[is_word], out[~is_word] = words.hashes(), END
    return out, np.concatenate(([0], ends))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    return keys[edge[:-1]], np.diff(edge)


def combine(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (numbers or rows of them)."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(count, edge, axis=0) if len(edge) else count


@dataclass(frozen=True)
class Packing:
    """Two numbers as one key that sorts by the first, then the second: 64 bits, or a complex number where they need more.

    Complex numbers sort by their real parts first, and either part holds an
    integer of 53 bits exactly.
    """

    first_bits: int
    second_bits: int
    wide: bool

    @classmethod
    def of(cls, first: int, second: int) -> Packing:
        """For numbers up to these."""
        a, b = (max(x, 1).bit_length() for x in (first, second))
        if max(a, b) > 53:
            raise ValueError("a table of more than 2**53 n-grams")
        return cls(a, b, a + b > KEY_BITS)

    @property
    def kind(self):
        return np.complex128 if self.wide else U64

    def pack(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not self.wide:
            return first.astype(U64) << U64(self.second_bits) | second.astype(U64)
        key = np.empty(len(first), np.complex128)
        key.real, key.imag = first, second
        return key

    def unpack(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.wide:
            return key.real.astype(np.int64), key.imag.astype(np.int64)
        return (key >> U64(self.second_bits)).astype(np.int64), (key & U64((1 << self.second_bits) - 1)).astype(np.int64)

    def least(self, first: int) -> int | complex | None:
        """The least key with this first number; None past the last one."""
        if first >= 1 << (64 - self.second_bits) and not self.wide:
            return None
        return complex(first, 0) if self.wide else first << self.second_bits


@dataclass(frozen=True)
class Mixing:
    """Pairs of word ids as keys that are spread evenly, however frequent a word or pair is; one to one."""

    packing: Packing

    @classmethod
    def of(cls, vocabulary: int) -> Mixing:
        packing = Packing.of(vocabulary, vocabulary)
        return cls(packing if packing.wide else Packing(32, 32, False))

    def mixed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not self.packing.wide:
            return mix(self.packing.pack(left, right))
        # Each number in turn is changed by a hash of the other.
        mask = U64((1 << self.packing.first_bits) - 1)
        right = right.astype(U64) ^ (mix(left.astype(U64)) & mask)
        return self.packing.pack(left.astype(U64) ^ (mix(right) & mask), right)

    def unmixed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.packing.wide:
            return self.packing.unpack(unmix(key))
        mask = U64((1 << self.packing.first_bits) - 1)
        left, right = (x.astype(U64) for x in self.packing.unpack(key))
        left = left ^ (mix(right) & mask)
        return left.astype(np.int64), (right ^ (mix(left) & mask)).astype(np.int64)

    def ranges(self, shards: int) -> list[tuple[int, int | complex, int | complex | None]]:
        """Even ranges of keys: number, first key, and the first key past the range."""
        if not self.packing.wide:
            cuts = [-(-(k << 64) // shards) for k in range(shards)]
        else:
            cuts = [complex(-(-(k << self.packing.first_bits) // shards), 0) for k in range(shards)]
        return [(k, cut, after) for k, (cut, after) in enumerate(zip(cuts, [*cuts[1:], None], strict=True))]


def span_of(keys: np.ndarray, low: int | complex, high: int | complex | None) -> tuple[int, int]:
    """Where sorted keys from ``low`` on and below ``high`` are."""
    a, b = (len(keys) if x is None else int(np.searchsorted(keys, np.array(x, keys.dtype))) for x in (low, high))
    return a, b


def shard_of_hash(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Which of some equal ranges of the 64-bit space a hash lies in."""
    return ((hashes >> U64(32)) * U64(shards)) >> U64(32)


#: Types of stored arrays.
KINDS = [np.dtype(kind) for kind in (np.uint8, np.uint32, np.int64, np.uint64, np.complex128)]
#: Numbers before the arrays of a file (a type and a length for each), and the bytes that arrays begin at multiples of.
HEAD, ALIGN = 16, 16


def store(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays as one file, as a task opens the files of every shard or run."""
    head = np.full(HEAD, -1, np.int64)
    head[: 2 * len(arrays)] = [x for array in arrays for x in (KINDS.index(array.dtype), len(array))]
    with Files(folder).write(name) as out:
        out.write(head.tobytes())
        for array in arrays:
            out.write(np.ascontiguousarray(array).view(np.uint8).data)
            out.write(bytes(-array.nbytes % ALIGN))


def load(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped: from a mounted folder, or from a copy that has no name and goes with the mapping."""
    files = Files(folder)
    with files.read(name) as source, source if files.store is None else tempfile.TemporaryFile() as here:
        if files.store is not None:
            shutil.copyfileobj(source, here, 8 << 20)
            here.flush()
        # A mapping needs no open file.
        held = mmap.mmap(here.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    at, out = 8 * HEAD, []
    for kind, size in np.frombuffer(held, np.int64, HEAD).reshape(-1, 2).tolist():
        if kind >= 0:
            out.append(np.frombuffer(held, KINDS[kind], size, at) if size else np.zeros(0, KINDS[kind]))
            at += -(-out[-1].nbytes // ALIGN) * ALIGN
    return out


class Narrow:
    """An array of counts: a byte each, and a list of the larger ones with their places."""

    def __init__(self, small: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
        self.small, self.at, self.more = small, at, more

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = self.small[at].astype(np.int64)
        large = out == 255
        if large.any():
            out[large] = self.more[np.searchsorted(self.at, at[large])]
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        out = self.small[begin:end].astype(np.int64)
        a, b = np.searchsorted(self.at, (begin, end))
        out[self.at[a:b] - begin] = self.more[a:b]
        return out


def narrow(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of :class:`Narrow`."""
    at = np.flatnonzero(values >= 255)
    return np.minimum(values, 255).astype(np.uint8), at, values[at].astype(np.int64)


@dataclass
class Table:
    """Sorted keys with values, in shards of rising key ranges; ``firsts`` are the ranges' first keys."""

    folder: str
    names: list[str]
    sizes: list[int]
    firsts: list[int | complex]
    _maps: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_maps": None}

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray | Narrow]:
        """Keys and values."""
        key, *value = load(self.folder, self.names[k])
        return key, Narrow(*value) if len(value) == 3 else value[0]

    def maps(self) -> list[tuple[np.ndarray, np.ndarray | Narrow]]:
        if self._maps is None:
            self._maps = [self.shard(k) for k in range(len(self.names))]
        return self._maps

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct keys: their places in the table (-1: absent) and their values (0: absent)."""
        place, value = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        cuts = [0, *np.searchsorted(keys, np.array(self.firsts[1:], keys.dtype)).tolist(), len(keys)]
        before = 0
        for k, (key, values) in enumerate(self.maps()):
            a, b = cuts[k], cuts[k + 1]
            if a < b and self.sizes[k]:
                at = np.searchsorted(key, keys[a:b])
                at[at == self.sizes[k]] = 0
                hit = np.flatnonzero(key[at] == keys[a:b])
                place[a + hit] = before + at[hit]
                value[a + hit] = values[at[hit]]
            before += self.sizes[k]
        return place, value


@dataclass
class Figures:
    """Counts for each place of a table (or rows of them), by the table's shards."""

    folder: str
    names: list[str]
    sizes: list[int]
    width: int = 1
    _maps: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_maps": None}

    def at(self, places: np.ndarray) -> np.ndarray:
        """A row of counts for each of rising places."""
        if self._maps is None:
            self._maps = [Narrow(*load(self.folder, name)) for name in self.names]
        out, bounds = np.zeros((len(places), self.width), np.int64), np.cumsum([0, *self.sizes])
        cuts = np.searchsorted(places, bounds).tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out[a:b] = self._maps[k][(places[a:b] - bounds[k])[:, None] * self.width + np.arange(self.width)]
        return out


PARTS = "shard int, keys binary, counts binary"


def _parts(key: np.ndarray, count: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Keys with counts, cut where the (rising) shard changes."""
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).tolist() if len(key) else [0]
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(shard[a]) for a, _ in spans], pa.int32()), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary())],
        names=["shard", "keys", "counts"],
    )


def _count(texts: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], shards: int) -> DataFrame:
    """Keys of all texts, summed up per task and dealt by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), 0
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                key, count = distinct(keys_of(part.column(0)))
                held[0].append(key)
                held[1].append(count)
                size += len(key)
                if size > MOST_KEYS:
                    key, count = combine(*held)
                    if len(key) > MOST_KEYS // 2:
                        yield _parts(key, count, shard_of_hash(key, shards))
                        held, size = ([], []), 0
                    else:
                        held, size = ([key], [count]), len(key)
        if size:
            key, count = combine(*held)
            yield _parts(key, count, shard_of_hash(key, shards))

    return texts.mapInArrow(tidy(run), PARTS).repartitionById(shards, F.col("shard"))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The sums of each shard that a task was dealt."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for shard, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            own = held.setdefault(shard, ([], []))
            own[0].append(np.frombuffer(keys.as_buffer(), U64))
            own[1].append(np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
            if len(own[0]) >= 24:
                key, count = combine(*own)
                held[shard] = ([key], [count])
    for shard in sorted(held):
        yield shard, *combine(*held.pop(shard))


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "name" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def _new_name(label: str, shard: int) -> str:
    return f"{label}-{shard:06d}-{uuid.uuid4().hex}"


def _store_run(folder: str, key: np.ndarray, count: np.ndarray) -> tuple[str]:
    name = f"run-{uuid.uuid4().hex}"
    store(folder, name, key, *narrow(count))
    return (name,)


def _sorted_runs(texts: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], folder: str) -> list[str]:
    """Keys of all texts, summed up per task and stored as sorted runs in a folder; their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = ([], []), 0, []
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                key, count = distinct(keys_of(part.column(0)))
                held[0].append(key)
                held[1].append(count)
                size += len(key)
                if size > MOST_KEYS:
                    key, count = combine(*held)
                    if len(key) > MOST_KEYS // 2:
                        names.append(_store_run(folder, key, count))
                        held, size = ([], []), 0
                    else:
                        held, size = ([key], [count]), len(key)
        if size:
            names.append(_store_run(folder, *combine(*held)))
        yield _rows(names, ["name"])

    return sorted(r["name"] for r in texts.mapInArrow(tidy(run), "name string").collect())


def _merged(spark: SparkSession, folder: str, names: list[str], shards: list[tuple], work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, kind=U64) -> DataFrame:
    """``work(shard, keys, counts)`` on the sums of all runs, for shards given as number, first key and first key past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                shard, low, high = shards[number]
                held = ([np.zeros(0, kind)], [np.zeros(0, np.int64)])
                for name in names:
                    key, *count = load(folder, name)
                    a, b = span_of(key, low, high)
                    if a == b:
                        continue
                    held[0].append(np.array(key[a:b]))
                    held[1].append(Narrow(*count).span(a, b))
                    if len(held[0]) >= 24:
                        key, count = combine(*held)
                        held = ([key], [count])
                yield from work(shard, *combine(*held))

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(tidy(run), schema)


def count_words(texts: DataFrame, folder: str, shards: int) -> tuple[Table, int]:
    """The vocabulary with word counts, and the number of tokens."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for shard, key, count in _by_shard(batches):
            name = _new_name("words", shard)
            store(folder, name, key, count)
            rows.append((shard, name, len(key), int(count.sum())))
        yield _rows(rows, ["shard", "name", "size", "total"])

    rows = sorted(_count(texts, lambda c: tokens_of(c)[0], shards).mapInArrow(tidy(merge), "shard long, name string, size long, total long").collect())
    table = Table(folder, [r["name"] for r in rows], [r["size"] for r in rows], [(r["shard"] << 64) // shards for r in rows])
    return table, sum(r["total"] for r in rows)


def end_of(words: Table) -> int:
    """The end token's id."""
    return int(words.find(np.array([END], U64))[0][0])


def look_up(table: Table, keys: np.ndarray) -> np.ndarray:
    """Places (-1: absent) of keys in any order."""
    key, which = np.unique(keys, return_inverse=True)
    return table.find(key)[0][which]


@dataclass
class Model:
    """A fitted model; its arrays lie in ``folder``."""

    words: Table
    bigrams: Table
    #: Per word id, in shards of ``stat_span`` ids: followers by their count (one, two, more); distinct words before it; the sum of its followers' counts.
    stat_names: list[str]
    stat_span: int
    n_tokens: int
    n_bigrams: int
    high: list[float]
    low: list[float]
    #: Words by how many distinct words precede them: one, two, three or more.
    low_counts: list[int]
    mixing: Mixing
    #: At order 3: trigrams and their keys, their discounts, and per bigram its count in the lower estimate and (in a row) its followers seen once, twice, more often.
    trigrams: Table | None = None
    packing: Packing | None = None
    top: list[float] | None = None
    lower: Figures | None = None
    followers: Figures | None = None
    _stats: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_stats": None}

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """The five figures of words (rows of zeros for unknown ones)."""
        if self._stats is None:
            self._stats = [load(self.words.folder, name)[0].reshape(-1, 5) for name in self.stat_names]
        out = np.zeros((len(ids), 5))
        shard = np.where(ids >= 0, ids // max(self.stat_span, 1), -1)
        for k in np.unique(shard[shard >= 0]).tolist():
            at = np.flatnonzero(shard == k)
            out[at] = self._stats[k][ids[at] - k * self.stat_span]
        return out

    def _with_trigrams(self, p: np.ndarray, ids: np.ndarray, first: np.ndarray, slot: np.ndarray, place: np.ndarray, occur: np.ndarray) -> np.ndarray:
        """Estimates ``p`` by one word of context, interpolated into those by two; a text's first token has but one.

        ``slot`` is which of the distinct bigrams with these places and counts a token ends (-1: none that is known).
        """
        inner = np.ones(len(ids), bool)
        inner[first[:-1]] = False
        # The bigram before a token is that of the token before it.
        now = np.flatnonzero(inner)
        now = now[slot[now - 1] >= 0]
        before = slot[now - 1]
        hit = np.flatnonzero(place >= 0)
        weight = np.zeros(len(place))
        weight[hit] = sum(d * n for d, n in zip(self.top[1:], self.followers.at(place[hit]).T, strict=True)) / occur[hit]
        known = ids[now] >= 0
        key, which = np.unique(self.packing.pack(place[before[known]], ids[now[known]]), return_inverse=True)
        seen = self.trigrams.find(key)[1]
        above = np.zeros(len(now))
        above[known] = cut(seen, self.top)[which]
        out = p.copy()
        out[now] = above / occur[before] + weight[before] * p[now]
        return out

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Per text: tokens, known ones, and both log10 probabilities."""
        tokens, first = tokens_of(column)
        vocabulary = self.words.size
        key, which = np.unique(tokens, return_inverse=True)
        place, count = self.words.find(key)
        stats = self.stats(place)
        ids = place[which]

        floor = 1.0 / (vocabulary + 1)
        continuation = stats[:, 3]
        if self.n_bigrams:
            left_over = sum(d * n for d, n in zip(self.low[1:], self.low_counts, strict=True)) / self.n_bigrams
            lower = cut(continuation, self.low) / self.n_bigrams + left_over * floor
        else:
            lower = np.full(len(key), floor)
        context_total = stats[:, 4]
        context_weight = (stats[:, :3] @ np.array(self.high[1:])) / np.maximum(context_total, 1)

        # The word before each token; the end token stands before a text's first.
        before = np.empty_like(which)
        before[1:] = which[:-1]
        before[first[:-1]] = np.searchsorted(key, END)
        left = place[before]
        known = np.flatnonzero((left >= 0) & (ids >= 0))
        hashed, back = np.unique(self.mixing.mixed(left[known], ids[known]), return_inverse=True)
        at, occur = self.bigrams.find(hashed)
        seen = occur
        if self.lower is not None:
            hit = np.flatnonzero(at >= 0)
            seen = np.zeros(len(at))
            seen[hit] = self.lower.at(at[hit])[:, 0]
        above = np.zeros(len(tokens))
        above[known] = cut(seen, self.high)[back]
        total = context_total[before]
        p = np.where(total > 0, above / np.maximum(total, 1) + context_weight[before] * lower[which], lower[which])
        if self.trigrams is not None:
            slot = np.full(len(tokens), -1)
            slot[known] = np.where(at >= 0, np.arange(len(at)), -1)[back]
            p = self._with_trigrams(p, ids, first, slot, at, occur)
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)
        return {"n_tokens": np.diff(first), "n_known": add((count > 0).astype(np.int64)[which]), "base_score": add(base[which]), "score": add(np.log10(p))}


def cut(counts: np.ndarray, by: list[float]) -> np.ndarray:
    """Counts less their discounts, 0 at least."""
    return np.maximum(counts - np.array(by)[np.minimum(counts, 3).astype(int)], 0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, 3 or more; usual values where the counts allow none."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *(min(max(d, 0.05), c - 0.05) for c, d in enumerate(found, 1))]


def _word_figures(left: np.ndarray, right: np.ndarray, count: np.ndarray, span: int) -> pa.RecordBatch:
    """What counted pairs of word ids add to the figures of either word."""
    kind = np.minimum(count, 3) - 1
    of, back = np.unique(np.concatenate((left, right)), return_inverse=True)
    table = np.bincount(back * 5 + np.concatenate((kind, np.full(len(left), 3))), minlength=5 * len(of)).reshape(-1, 5)
    table[:, 4] = np.bincount(back[: len(left)], count, minlength=len(of))
    return _parts(of, table, of // span)


def _tallies(count: np.ndarray) -> tuple[int, ...]:
    return tuple(int((count == c).sum()) for c in (1, 2, 3, 4))


def _told(*row) -> pa.RecordBatch:
    """A row for the driver among parts."""
    return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([repr(row).encode()]), pa.array([b""])], names=["shard", "keys", "counts"])


def _heard(parts: list[DataFrame]) -> list[tuple]:
    return sorted(ast.literal_eval(bytes(r["keys"]).decode()) for some in parts for r in some.where("shard = -1").select("keys").collect())


def fit(texts: DataFrame, shards: int | None = None, folder: str | None = None, order: int = 2) -> Model:
    """Train a model of the given order (2 or 3) on the column ``text``."""
    if order not in (2, 3):
        raise ValueError("the order must be 2 or 3")
    spark = texts.sparkSession
    bound_arrow(spark)
    shards = shards or shuffle_partitions(spark)
    folder = folder or new_folder(spark, "language-model")
    texts = texts.select(F.col("text"))
    words, n_tokens = count_words(texts, folder, shards)
    vocabulary = words.size
    mixing = Mixing.of(vocabulary)
    shards = max(shards, -(-n_tokens // SHARD_TOKENS))
    span = max(1, -(-vocabulary // shards))

    def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: the mixed pair that it ends, its word's id, and whether its text begins with it."""
        tokens, first = tokens_of(column)
        ids = look_up(words, tokens).astype(U64)
        begins = np.zeros(len(ids), bool)
        begins[first[:-1]] = True
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[begins] = U64(end_of(words))
        return mixing.mixed(before, ids), ids, begins

    def merge(shard: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Store each shard; at order 2, pass on what it holds per word."""
        name = _new_name("bigrams", shard)
        store(folder, name, key, *narrow(count))
        yield _told(shard, name, len(key), *_tallies(count))
        if order == 2:
            yield _word_figures(*mixing.unmixed(key), count, span)

    runs = new_folder(spark, "language-model-runs")
    names = _sorted_runs(texts, lambda c: pairs_of(c)[0], runs)
    ranges = mixing.ranges(shards)
    parts = [materialize(_merged(spark, runs, names, ranges, merge, PARTS, mixing.packing.kind), "language-model-stats")]
    delete_folder(spark, runs)
    rows = _heard(parts)
    bigrams = Table(folder, [r[1] for r in rows], [r[2] for r in rows], [ranges[r[0]][1] for r in rows])
    high = discounts(*[sum(r[3 + k] for r in rows) for k in range(4)])
    more: dict = {}
    if order == 3:
        discard(*parts)
        parts, high, more = _fit_trigrams(texts, folder, pairs_of, words, mixing, bigrams, span)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, ids, table in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                # A part has each id once.
                whole = held.setdefault(shard, np.zeros((span, 5), np.int64))
                whole[np.frombuffer(ids.as_buffer(), np.int64) - shard * span] += np.frombuffer(table.as_buffer(), np.uint32).reshape(-1, 5)
        out = []
        for shard, whole in sorted(held.items()):
            name = _new_name("stats", shard)
            store(folder, name, (whole.astype(np.uint32) if whole.max() < 1 << 32 else whole).ravel())
            out.append((shard, name, *_tallies(whole[:, 3]), int((whole[:, 3] >= 3).sum())))
        yield _rows(out, ["shard", "name", "n1", "n2", "n3", "n4", "more"])

    figures = reduce(DataFrame.unionAll, parts).where("shard >= 0")
    stats = sorted(figures.repartitionById(shards, F.col("shard")).mapInArrow(tidy(gather), "shard long, name string, n1 long, n2 long, n3 long, n4 long, more long").collect())
    discard(*parts)
    low = discounts(*[sum(r[c] for r in stats) for c in ("n1", "n2", "n3", "n4")])
    low_counts = [sum(r["n1"] for r in stats), sum(r["n2"] for r in stats), sum(r["more"] for r in stats)]
    return Model(words, bigrams, [r["name"] for r in stats], span, n_tokens, bigrams.size, high, low, low_counts, mixing, **more)


def _passes(ranges: list[tuple]) -> list[list[tuple]]:
    """The shards in parts that are worked on one after another; one empty part if there are no shards."""
    some = [ranges[turn * len(ranges) // PASSES : (turn + 1) * len(ranges) // PASSES] for turn in range(PASSES)]
    return [part for part in some if part] or [[]]


def _inside(keys: np.ndarray, low: int | complex, high: int | complex | None) -> np.ndarray:
    """Whether keys in any order are from ``low`` on and below ``high``."""
    inside = keys >= np.array(low, keys.dtype)
    return inside if high is None else inside & (keys < np.array(high, keys.dtype))


def _fit_trigrams(texts: DataFrame, folder: str, pairs_of: Callable, words: Table, mixing: Mixing, bigrams: Table, span: int) -> tuple[list[DataFrame], list[float], dict]:
    """Figures per word and discounts of the lower order, and the model's fields of order 3."""
    spark = texts.sparkSession
    packing = Packing.of(bigrams.size, words.size)
    start = np.concatenate(([0], np.cumsum(bigrams.sizes))).astype(int).tolist()
    # Shards are those of the bigrams: by the first two words, or by the last two.
    pairs_in = [(k, low, high) for (k, low, high), size in zip(mixing.ranges(len(bigrams.sizes)), bigrams.sizes, strict=True) if size]
    triples_in = [(k, packing.least(start[k]), packing.least(start[k + 1])) for k, _, _ in pairs_in]

    def trigrams(shard: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = packing.unpack(key)[0] - start[shard]
        name = _new_name("trigrams", shard)
        store(folder, name, key, *narrow(count))
        followers = np.empty((bigrams.sizes[shard], 3), np.uint32)
        for kind in range(3):
            followers[:, kind] = np.bincount(at[np.minimum(count, 3) == kind + 1], minlength=len(followers))
        store(folder, f"{name}.followers", *narrow(followers.ravel()))
        yield _told(shard, name, len(key), *_tallies(count))

    told = []
    for some, pairs_here in zip(_passes(triples_in), _passes(pairs_in), strict=True):

        def keys_of(column: pa.Array, here: list = pairs_here) -> np.ndarray:
            pairs, ids, begins = pairs_of(column)
            later = np.flatnonzero(~begins)
            # The bigram before a token is that of the token before it; of this pass are those of its shards.
            context = pairs[later - 1]
            inside = np.flatnonzero(_inside(context, here[0][1], here[-1][2]))
            return packing.pack(look_up(bigrams, context[inside]), ids[later[inside]])

        runs = new_folder(spark, "language-model-runs")
        names = _sorted_runs(texts, keys_of, runs) if some else []
        told += _heard([_merged(spark, runs, names, some, trigrams, PARTS, packing.kind)])
        delete_folder(spark, runs)
    told.sort()
    table = Table(folder, [r[1] for r in told], [r[2] for r in told], [packing.least(start[r[0]]) for r in told])
    followers = Figures(folder, [f"{r[1]}.followers" for r in told], [bigrams.sizes[r[0]] for r in told], 3)
    top = discounts(*[sum(r[3 + k] for r in told) for k in range(4)])

    parts, lower, high = _preceded(spark, folder, told, packing, mixing, bigrams, pairs_in, start, end_of(words), span)
    return parts, high, {"trigrams": table, "packing": packing, "top": top, "lower": lower, "followers": followers}


def _preceded(spark: SparkSession, folder: str, told: list[tuple], packing: Packing, mixing: Mixing, bigrams: Table, pairs_in: list[tuple], start: list[int], end: int, span: int) -> tuple[list[DataFrame], Figures, list[float]]:
    """What bigrams count in the lower estimate: the distinct trigrams that each ends, or how often it begins a text."""

    def last_two(here: list[tuple], runs: str) -> list[str]:
        """Bigrams of some shards that end the distinct trigrams, as sorted runs; a task reads as many shards as there are passes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, names = [], 0, []
            for number in (number for batch in batches for number in batch.column(0).to_pylist()):
                shard, name = told[number][:2]
                middle = mixing.unmixed(bigrams.shard(shard)[0])[1]
                keys = load(folder, name)[0]
                for begin in range(0, len(keys), MOST_KEYS):
                    context, last = packing.unpack(keys[begin : begin + MOST_KEYS])
                    pairs = mixing.mixed(middle[context - start[shard]], last)
                    held.append(pairs[_inside(pairs, here[0][1], here[-1][2])])
                    size += len(held[-1])
                    if size > MOST_KEYS:
                        names.append(_store_run(runs, *distinct(np.concatenate(held))))
                        held, size = [], 0
            if size:
                names.append(_store_run(runs, *distinct(np.concatenate(held))))
            yield _rows(names, ["name"])

        tasks = max(1, -(-len(told) // PASSES))
        return sorted(r["name"] for r in spark.range(0, len(told), 1, tasks).mapInArrow(tidy(run), "name string").collect())

    def lower_counts(shard: int, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs, occur = bigrams.shard(shard)
        left, right = mixing.unmixed(pairs)
        total = np.where(left == end, occur.span(0, len(pairs)), 0)
        total[np.searchsorted(pairs, key)] += count
        name = _new_name("lower", shard)
        store(folder, name, *narrow(total))
        yield _told(shard, name, *_tallies(total))
        yield _word_figures(left, right, total, span)

    parts = []
    for here in _passes(pairs_in):
        runs = new_folder(spark, "language-model-runs")
        names = last_two(here, runs) if here else []
        parts.append(materialize(_merged(spark, runs, names, here, lower_counts, PARTS, mixing.packing.kind), "language-model-stats"))
        delete_folder(spark, runs)
    rows = _heard(parts)
    lower = Figures(folder, [r[1] for r in rows], [bigrams.sizes[r[0]] for r in rows])
    return parts, lower, discounts(*[sum(r[2 + k] for r in rows) for k in range(4)])


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x ^ (x >> U64(31)) ^ (x >> U64(62))
    x = x * U64(pow(0x94D049BB133111EB, -1, 2**64))
    x = x ^ (x >> U64(27)) ^ (x >> U64(54))
    x = x * U64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: Column | None = None, model: Model | None = None, order: int = 2) -> DataFrame:
    """Scores of all rows by a model trained, at the given order, on those that are not held out (id fold 1 by default)."""
    bound_arrow(docs.sparkSession)
    out_of = fold_of(F.col(f"`{key}`")) == 1 if held_out is None else F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(f"`{key}`").alias("__key"), out_of.alias("held_out"), F.col(f"`{text}`").alias("text"))
    model = model or fit(source.where("not held_out"), order=order)
    kind = source.schema["__key"].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                found = model.score(part.column(2))
                total = pa.array(np.full(part.num_rows, model.n_tokens, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(found[c]) for c in ("n_tokens", "n_known")], total, *[pa.array(found[c]) for c in ("base_score", "score")]], names=names)

    return source.mapInArrow(tidy(run), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
