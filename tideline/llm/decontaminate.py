"""Benchmark decontamination: q-gram lemma filtering, then banded alignment.

Texts and benchmark items are case-folded and their white space is made one
space. What is looked for are windows of items: every run of ``passage``
characters of an item, wherever it begins, and the whole item if it has fewer
than twice as many. A window of L characters may differ from a document's
passage in ``edit_rate`` of L edits, rounded down.

A window of L characters with at most k edits shares at least L - q + 1 - k*q
of its q-grams with the matching passage, on at most k + 1 neighbouring
diagonals. So the q-grams that a text shares with an item are counted in strips
of k + 1 diagonals; two neighbouring strips are a band, so bands overlap by
half and one of them holds any match whole. Of bands that reach the bound,
those windows are kept that hold enough of the shared q-grams, and are aligned
inside the band. Neighbouring windows differ by at most one edit, so a window
that is far off rules out those around it. q is ``LeakRules.q``, or less for
windows so short that the bound would not be positive.

The index is built once, by tasks, in blocks of about ``BLOCK_CHARS``
characters of the benchmark, and lies in the shared folder. Tasks map the
blocks one after another for each batch of documents: the documents are read
once, and neither they nor the benchmark pass through the driver.

Cases: null or empty texts match nothing, nor do null or empty items; items of
so few characters that no edit is allowed (under 10) are found where they stand
exactly, as whole words; very long texts are searched whole, in pieces of
bounded numbers of shared q-grams; repeated documents and repeated items give
their own result rows; of several places of an item in a text, one within the
edit bound is told; an empty table gives an empty result. Keys and item ids may
have any type. Results carry only the named key columns, whatever other columns
the tables have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tideline.llm.store import Files, bound_arrow, load_array, new_folder, store_array, tidy
from tideline.llm.words import slices

BLOCK_CHARS = 2_000_000
#: Shared q-grams, and cells of alignments, that are worked on together.
_HITS, _CELLS = 500_000, 1 << 20
#: Bytes of text that are searched together; a longer text is searched whole.
_TEXT_BYTES = 1 << 19
_SEPARATOR = 0x10FFFF
U64 = np.uint64


@dataclass(frozen=True)
class LeakRules:
    q: int = 8
    edit_rate: float = 0.10
    passage: int = 64


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each position, built by doubling."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, size, h, out, done = 0x9E3779B97F4A7C15, 1, code.astype(U64), None, 0
    while True:
        if q & size:
            out = h[:n].copy() if out is None else out * U64(pow(base, size, 2**64)) + h[done : done + n]
            done += size
        if 2 * size > q:
            break
        h = h[: len(h) - size] * U64(pow(base, size, 2**64)) + h[size:]
        size *= 2
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    return out


def align(windows: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits between each window and a passage of its text in a band of diagonals, with the passage's bounds.

    A row of ``texts`` begins at the band's first diagonal and is longer than a
    window by the band's width less one; it is padded with a code that no window has.
    All pairs advance together, a character of the windows at a time.
    """
    n, size = windows.shape
    width = texts.shape[1] - size + 1
    one = np.int64(1 << 32)
    cost = np.broadcast_to(np.arange(width, dtype=np.int64), (n, width)).copy()  # edits << 32 | start
    shift = np.arange(width, dtype=np.int64) * one
    for i in range(size):
        step = cost + (texts[:, i : i + width] != windows[:, i : i + 1]) * one
        np.minimum(step[:, :-1], cost[:, 1:] + one, out=step[:, :-1])
        step -= shift
        cost = np.minimum.accumulate(step, axis=1)
        cost += shift
    at = np.argmin(cost >> 32, axis=1)
    best = cost[np.arange(n), at]
    return best >> 32, best & 0xFFFFFFFF, at + size


def _expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all members of spans that begin somewhere and have some members."""
    total = np.cumsum(count)
    return np.repeat(begin - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of rows that are equal in all keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class ItemIndex:
    """Items in one array of codes, what is looked for in each (``kinds``), and per q the places of all q-grams.

    A row of ``kinds``: item, window size, edits, q, least shared q-grams.
    """

    ARRAYS = ("letters", "begin", "kinds")
    GRAMS = ("gram", "first", "count", "kind", "place")

    def __init__(self, arrays: dict[str, np.ndarray], grams: dict[int, dict[str, np.ndarray]]) -> None:
        self.letters, self.begin, self.kinds = (arrays[a] for a in self.ARRAYS)
        self.grams = grams
        self.bitmaps = {}
        for q, own in grams.items():
            self.bitmaps[q] = np.zeros(1 << 22, bool)
            self.bitmaps[q][own["gram"] >> U64(42)] = True

    @classmethod
    def build(cls, texts: list[str | None], rules: LeakRules) -> ItemIndex:
        items = [codes(normal(t or "")) for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)
        kinds = []
        for number, item in enumerate(items):
            sizes = {min(len(item), rules.passage), len(item) if len(item) < 2 * rules.passage else rules.passage}
            for size in sorted(sizes - {0}):
                k = int(rules.edit_rate * size + 1e-9)
                q = max(1, min(rules.q, size // (k + 1)))
                kinds.append((number, size, k, q, max(1, size - q + 1 - k * q)))
        table = np.array(kinds, np.int64).reshape(-1, 5)
        grams = {}
        for q in np.unique(table[:, 3]).tolist():
            some = np.flatnonzero(table[:, 3] == q)
            hashed = [gram_hashes(items[i], q) for i in table[some, 0]]
            gram = np.concatenate(hashed)
            kind = np.repeat(some, [len(h) for h in hashed])
            place = np.concatenate([np.arange(len(h)) for h in hashed])
            order = np.argsort(gram, kind="stable")
            gram = gram[order]
            first = np.flatnonzero(_starts(gram))
            grams[q] = {"gram": gram[first], "first": first, "count": np.diff(np.append(first, len(gram))), "kind": kind[order], "place": place[order]}
        return cls({"letters": np.concatenate([*items, np.zeros(0, np.uint32)]), "begin": begin, "kinds": table}, grams)

    def save(self, folder: str, name: str) -> None:
        store_array(folder, f"{name}.qs.npy", np.array(sorted(self.grams), np.int64))
        for a in self.ARRAYS:
            store_array(folder, f"{name}.{a}.npy", getattr(self, a))
        for q, own in self.grams.items():
            for a in self.GRAMS:
                store_array(folder, f"{name}.{q}.{a}.npy", own[a])

    @classmethod
    def load(cls, folder: str, name: str) -> ItemIndex:
        qs = load_array(folder, f"{name}.qs.npy").tolist()
        return cls({a: load_array(folder, f"{name}.{a}.npy") for a in cls.ARRAYS}, {q: {a: load_array(folder, f"{name}.{q}.{a}.npy") for a in cls.GRAMS} for q in qs})

    def hits(self, code: np.ndarray, q: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shared q-grams (place in the text, kind, place in the item), in pieces that overlap by more than a window."""
        own, h = self.grams[q], gram_hashes(code, q)
        at = np.flatnonzero(self.bitmaps[q][h >> U64(42)])
        which = np.searchsorted(own["gram"], h[at])
        which[which == len(own["gram"])] = 0
        true = own["gram"][which] == h[at]
        at, which = at[true], which[true]
        if not len(at):
            return
        count, first = own["count"][which], own["first"][which]
        total = np.cumsum(count)
        sizes = self.kinds[self.kinds[:, 3] == q]
        overlap = int((sizes[:, 1] + 2 * sizes[:, 2]).max())
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _HITS, "right")))
            # A piece goes on as far as a window that begins in it.
            end = int(np.searchsorted(at, at[b - 1] + overlap, "right")) if b < len(at) else b
            posting = _expand(first[a:end], count[a:end])
            yield np.repeat(at[a:end], count[a:end]), own["kind"][posting], own["place"][posting]
            a = b

    def runs(self, code: np.ndarray, offsets: np.ndarray, q: int) -> np.ndarray:
        """Runs of windows that share enough q-grams with a text inside a band: kind, text, first diagonal, first and last window."""
        out = [np.zeros((0, 5), np.int64)]
        for at, kind, place in self.hits(code, q):
            k = self.kinds[kind, 2]
            strip = (at - place + (1 << 31)) // (k + 1)
            key = kind << 33 | strip
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(_starts(key))
            cell, count = key[first], np.diff(np.append(first, len(key)))
            # A band is a strip and the next one, and begins at a strip with hits or just before one; without edits it is one strip.
            wide, bound = self.kinds[cell >> 33, 2] > 0, self.kinds[cell >> 33, 4]
            follows = np.append(cell[1:] == cell[:-1] + 1, False) & wide
            both = count + np.where(follows, np.append(count[1:], 0), 0)
            here = np.flatnonzero(both >= bound)
            ahead = np.flatnonzero(~np.concatenate(([False], follows[:-1])) & wide & (count >= bound))
            begins = np.concatenate((cell[here], cell[ahead] - 1))
            if not len(begins):
                continue
            sizes = np.concatenate((both[here], count[ahead]))
            hit = order[_expand(first[np.concatenate((here, ahead))], sizes)]
            band = np.repeat(np.arange(len(begins)), sizes)
            doc = np.searchsorted(offsets, at[hit], "right") - 1
            order = np.lexsort((place[hit], doc, band))
            hit, band, doc = hit[order], band[order], doc[order]
            p, (_, size, _, _, bound) = place[hit], self.kinds[kind[hit]].T
            last = np.minimum(np.arange(len(hit)) + bound - 1, len(hit) - 1)
            ok = np.flatnonzero((np.arange(len(hit)) + bound <= len(hit)) & (band[last] == band) & (doc[last] == doc) & (p[last] - p <= size - q))
            if not len(ok):
                continue
            item = self.kinds[kind[hit[ok]], 0]
            most = self.begin[item + 1] - self.begin[item] - size[ok]
            low, high = np.maximum(p[last[ok]] - size[ok] + q, 0), np.minimum(p[ok], most)
            new = _starts(band[ok], doc[ok])
            new[1:] |= low[1:] > np.maximum.accumulate(high + (np.cumsum(new) << 40))[:-1] - (np.cumsum(new)[1:] << 40) + 1
            run = np.flatnonzero(new)
            owner = kind[hit[ok]][run]
            diagonal = (begins[band[ok]][run] & ((1 << 33) - 1)) * (self.kinds[owner, 2] + 1) - (1 << 31)
            runs = np.stack((owner, doc[ok][run], diagonal, low[run], np.maximum.reduceat(high, run)), axis=1)
            out.append(runs[runs[:, 3] <= runs[:, 4]])
        return np.unique(np.concatenate(out), axis=0)

    def windows(self, runs: np.ndarray, at: np.ndarray, code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edits, start and end (in its text) of one window per run, all of one size and bound."""
        kind, doc, diagonal = runs[:, 0], runs[:, 1], runs[:, 2]
        item, size, k = self.kinds[kind[0], 0], int(self.kinds[kind[0], 1]), int(self.kinds[kind[0], 2])
        item = self.kinds[kind, 0]
        width = 2 * (k + 1) if k else 1
        left = self.letters[(self.begin[item] + at)[:, None] + np.arange(size)]
        low = offsets[doc]
        from_ = at + diagonal
        places = from_[:, None] + np.arange(size + width - 1)
        inside = (places >= low[:, None]) & (places < offsets[doc + 1][:, None] - 1)
        right = np.where(inside, code[np.clip(places, 0, len(code) - 1)], np.uint32(0xFFFFFFFF))
        edits, start, end = align(left, right)
        length = offsets[doc + 1] - 1 - low
        start = np.clip(from_ + start - low, 0, length)
        return edits, start, np.clip(from_ + end - low, start, length)


def _inner(c: str) -> bool:
    """Whether a character goes on a word that stands beside it, in scripts that part words by spaces."""
    return c.isalnum() and c < "\u0e00"


def find_leaks_in(texts: list[str | None], index: ItemIndex) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of every item found, at places in the normalised text."""
    parts = [normal(t or "") for t in texts]
    # A separator that no text holds keeps q-grams inside their text.
    code = codes("".join(f"{p}{chr(_SEPARATOR)}" for p in parts))
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))).astype(np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q in index.grams:
        runs = index.runs(code, offsets, q)
        while len(runs):
            middle = (runs[:, 3] + runs[:, 4]) // 2
            edits = np.zeros(len(runs), np.int64)
            for shape in np.unique(index.kinds[runs[:, 0], 1:3], axis=0):
                same = np.flatnonzero((index.kinds[runs[:, 0], 1:3] == shape).all(axis=1))
                together = max(1, _CELLS // int(shape[0] + 2 * shape[1] + 2))
                for some in (same[a : a + together] for a in range(0, len(same), together)):
                    edits[some], start, end = index.windows(runs[some], middle[some], code, offsets)
                    for row in np.flatnonzero(edits[some] <= shape[1]).tolist():
                        kind, doc = runs[some[row], :2].tolist()
                        place, text = (int(edits[some[row]]), int(start[row]), int(end[row])), parts[doc]
                        if shape[1] == 0 and (place[1] and _inner(text[place[1] - 1]) or place[2] < len(text) and _inner(text[place[2]])):
                            continue  # a part of a word
                        key = doc, int(index.kinds[kind, 0])
                        best[key] = min(place, best.get(key, place))
            # A window that is off by more than the bound rules out as many windows around it.
            spare = edits - index.kinds[runs[:, 0], 2] - 1
            open_ = spare >= 0
            if best:
                found = np.array([d << 32 | i for d, i in best], np.int64)
                open_ &= ~np.isin(runs[:, 1] << 32 | index.kinds[runs[:, 0], 0], found)
            before, after = runs[open_].copy(), runs[open_].copy()
            before[:, 4], after[:, 3] = (middle - spare - 1)[open_], (middle + spare + 1)[open_]
            left = np.concatenate((before, after))
            runs = left[left[:, 3] <= left[:, 4]]
    return [(doc, item, start, end, edits) for (doc, item), (edits, start, end) in sorted(best.items())]


def _store_blocks(spark: SparkSession, benchmark: DataFrame, item_id: str, text: str, rules: LeakRules) -> tuple[str, list[str]]:
    """Build the index in tasks; the folder and the blocks' names."""
    folder = new_folder(spark, "benchmark-index")
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{text}`").alias("t")).where("id is not null and t is not null")
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = total // BLOCK_CHARS + 1
    blocks = items.groupBy(F.pmod(F.xxhash64("id", "t"), F.lit(n)).alias("block")).agg(F.collect_list("id").alias("ids"), F.collect_list("t").alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for row in range(batch.num_rows):
                name = f"block-{batch.column(0)[row].as_py():06d}"
                ids, texts = (pa.array(batch.column(c)[row].values) for c in (1, 2))
                order = pc.sort_indices(pa.table({"i": ids, "t": texts}), [("i", "ascending"), ("t", "ascending")]) if not pa.types.is_nested(ids.type) else pa.array(range(len(ids)))
                ids, texts = ids.take(order), texts.take(order)
                ItemIndex.build(texts.to_pylist(), rules).save(folder, name)
                with Files(folder).write(f"{name}.ids.arrow") as out, pa.ipc.new_file(out, pa.schema([("id", ids.type)])) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([ids], names=["id"]))
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return folder, sorted(r["name"] for r in blocks.mapInArrow(run, "name string").collect())


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: LeakRules | None = None) -> DataFrame:
    """One row per document and benchmark item found in it: key, ``item_id``, ``start``, ``end``, ``edits``."""
    rules = rules or LeakRules()
    spark = docs.sparkSession
    bound_arrow(spark)
    folder, blocks = _store_blocks(spark, benchmark, item_id, item_text, rules)
    source = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    schema = StructType([StructField(key, source.schema["__key"].dataType), StructField("item_id", benchmark.schema[item_id].dataType), *[StructField(n, IntegerType()) for n in ("start", "end", "edits")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, tuple] = {}

        def block(name: str) -> tuple:
            if name not in loaded:
                loaded.clear()  # one block in memory at a time
                with Files(folder).read(f"{name}.ids.arrow") as file:
                    loaded[name] = ItemIndex.load(folder, name), pa.ipc.open_file(file.read()).read_all().column(0).combine_chunks()
            return loaded[name]

        for batch in batches:
            for name in blocks:
                index, ids = block(name)
                for part in slices(batch, "__text", _TEXT_BYTES):
                    found = find_leaks_in(part.column(1).to_pylist(), index)
                    doc, item, start, end, edits = zip(*found, strict=True) if found else ([],) * 5
                    columns = [part.column(0).take(pa.array(doc, pa.int64())), ids.take(pa.array(item, pa.int64())), *[pa.array(x, pa.int32()) for x in (start, end, edits)]]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(tidy(run), schema)
