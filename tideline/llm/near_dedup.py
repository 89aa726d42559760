"""Near-duplicate documents by MinHash bands, odd sketches and full sets.

A document's set is its distinct five-word shingles. 128 MinHash samples give
32 bands of four; documents that share a band are candidates. The samples are
also folded into an odd sketch, a bitmap of 2,048 bits in which each sample
flips one bit, so the XOR of two sketches has few bits exactly when the sets
are very similar; candidates with too many are dropped. So are those whose
parity bitmaps, in which every shingle of the set flips one bit, differ in
more bits than the sets may differ in shingles; that bound is exact. What
remains is confirmed on the full sets: 100 * intersection >= threshold * union.

Documents with equal sets are one class from the start. In some rounds, one
class of each band's bucket, drawn by hash, is compared with the members that
are not yet in its component; as a document is in many buckets, this joins
nearly all of a group of copies. Only members that are still outside their
bucket's largest component are then compared with the rest of the bucket, so
no candidate link between components is left out and no group of copies is
expanded into all its pairs. Rounds end early once that last comparison is
light or a round has hardly made it lighter, as it finds whatever further
rounds would. That last comparison is dealt out in blocks of
``BLOCK_ROWS`` members, however large a bucket is.

Sets are compared as 52-bit hashes of their shingles: two shingles of a pair
of texts with m and n of them are confused with a probability of m * n / 2**52.

Cases: very long texts are signed and compared whole; texts without words have an empty set, are linked with nothing and
form their own component; a null id cannot be named by others, so the row has
a null component and is kept; rows that repeat an id belong to one component,
even if their texts differ; ties are settled by the smallest id; an empty
table gives an empty result; the result has no columns of the input but the
key. Ids must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components
from tideline.llm.store import bound_arrow, discard, materialize, shuffle_partitions, tidy
from tideline.llm.words import mix, segments, slices, window_hashes, words_of

U64 = np.uint64
#: Ids up to which the candidates' ids are broadcast to the scan; beyond, the same join is by shuffle.
BROADCAST_ROWS = 2_000_000
#: Rows about buckets (some 60 bytes each) up to which they are broadcast to the buckets' members.
BUCKET_ROWS = 500_000
#: Members of a bucket that a task compares with as many others at once.
BLOCK_ROWS = 512
#: Comparisons of sketches (2 to 3 microseconds each), per member of a bucket, up to which the last step is begun without further rounds.
LIGHT = 100
_WORDS = 32  # 64-bit words of a sketch


@dataclass(frozen=True)
class NearRules:
    threshold: int = 75
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    #: The most differing bits of two sketches of 2,048 bits. At a similarity of
    #: 0.75 about 62 differ, with a deviation of 9; unrelated sets differ in 226.
    most_bits: int = 106
    #: The most rounds of comparisons with one pivot per bucket, before the exhaustive one.
    rounds: int = 3


def _samples(rules: NearRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = rules.bands * rules.rows
    rng = np.random.Generator(np.random.PCG64(41))
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def sets_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (52 bits) of each text, and where each text's begin."""
    words = words_of(column)
    hashes = words.hashes()
    shingles, at = window_hashes(hashes, words.first, size)
    doc = words.doc[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        total = count[short].astype(U64) * U64(0xA24BAED4963EE407)
        for k in range(size - 1):
            has = count[short] > k
            total[has] = mix(total[has] ^ hashes[words.first[short[has]] + k]) + U64(k + 1)
        shingles, doc = np.concatenate((shingles, mix(total))), np.concatenate((doc, short))
    if words.n_docs > 4095:
        raise ValueError("too many texts at once")
    key = np.sort((doc.astype(U64) << U64(52)) | (shingles >> U64(12)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    first = np.searchsorted(key, np.arange(words.n_docs + 1, dtype=U64) << U64(52))
    return key & U64((1 << 52) - 1), first


def signatures(sets: np.ndarray, first: np.ndarray, rules: NearRules) -> dict[str, np.ndarray]:
    """Per text: set size, two fingerprints of the set, band keys and odd sketch."""
    n = len(first) - 1
    full, begin = segments(first)
    out = {"n": np.diff(first), "f1": np.zeros(n, U64), "f2": np.zeros(n, U64), "bands": np.zeros((n, rules.bands), U64), "sketch": np.zeros((n, _WORDS), U64), "parity": np.zeros((n, _WORDS), U64)}
    if not len(full):
        return out
    h = mix(sets)
    out["f1"][full], out["f2"][full] = np.add.reduceat(h, begin), np.bitwise_xor.reduceat(mix(h ^ U64(0x5DEECE66D)), begin)
    doc = np.repeat(np.arange(n), out["n"])
    flips = np.bincount(doc * (64 * _WORDS) + (h >> U64(20)).astype(np.int64) % (64 * _WORDS), minlength=n * 64 * _WORDS) & 1
    out["parity"] = np.packbits(flips.astype(np.uint8)).view(U64).reshape(n, _WORDS)
    x, y = (h >> U64(32)).astype(np.uint32), h.astype(np.uint32)
    rows = np.arange(len(full))
    sketch, band = np.zeros((len(full), _WORDS), U64), None
    for i, (a, b, c) in enumerate(zip(*_samples(rules), strict=True)):
        value = x * a
        value ^= y * b + c
        least = np.minimum.reduceat(value, begin).astype(U64)
        bit = mix(least ^ (U64(i + 1) << U64(40)))
        sketch[rows, (bit >> U64(6)).astype(np.int64) % _WORDS] ^= U64(1) << (bit & U64(63))
        if i % rules.rows == 0:
            band = np.full(len(full), i + 1, U64) * U64(0x9E3779B97F4A7C15)
        band = mix(band ^ least) + least
        if i % rules.rows == rules.rows - 1:
            out["bands"][full, i // rules.rows] = mix(band)
    out["sketch"][full] = sketch
    return out


def sign(docs: DataFrame, key: str, text: str, rules: NearRules) -> DataFrame:
    """``id``, ``n``, ``f1``, ``f2``, ``bands``, ``sketch``, ``parity`` of each row."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = signatures(*sets_of(part.column(1), rules.shingle), rules)
                wide = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1).view(np.int64))) for x in (found["bands"], found["sketch"], found["parity"])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found["n"].astype(np.int64)), *[pa.array(found[c].view(np.int64)) for c in ("f1", "f2")], *wide], names=["id", "n", "f1", "f2", "bands", "sketch", "parity"])

    return source.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>, parity array<long>")


def _alike(a: str, b: str, rules: NearRules) -> Column:
    """Whether sizes and sketches allow two sets to be similar enough."""

    def bits(name: str) -> Column:
        differ = F.zip_with(F.col(f"{a}.{name}"), F.col(f"{b}.{name}"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
        return F.aggregate(differ, F.lit(0), lambda s, x: s + x)

    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    # Sets of m and n shingles with this similarity differ in at most (1 - t) / (1 + t) * (m + n) of them.
    exact = (100 + rules.threshold) * bits("parity") <= (100 - rules.threshold) * (small + large)
    return (100 * small >= rules.threshold * large) & exact & (bits("sketch") <= rules.most_bits)


def _confirm(pairs: DataFrame, docs: DataFrame, key: str, text: str, rules: NearRules) -> DataFrame:
    """The pairs (``u``, ``v``; of documents with set fingerprints ``fu``, ``fv``) whose full sets are similar enough."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    ids = materialize(ids, "near-ids")
    few = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    right = pairs.join(texts.select(F.col("id").alias("v"), F.col("t").alias("tv")), "v")
    both = right.join(texts.select(F.col("id").alias("u"), F.col("t").alias("tu")), "u").select("u", "fu", "tu", "v", "fv", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (p for half in slices(batch, "tu", 2 << 20) for p in slices(half, "tv", 2 << 20)):
                u, fu, tu, v, fv, tv = part.columns
                # A row of pairs often shares its first text with the row before; an id may have several texts.
                once = tu.dictionary_encode(null_encoding="encode")
                which = once.indices.to_numpy()
                left, right = sets_of(once.dictionary, rules.shingle), sets_of(tv, rules.shingle)
                prints = [set_prints(*x) for x in (left, right)]
                ok = np.zeros(part.num_rows, bool)
                fu, fv = fu.to_numpy(), fv.to_numpy()
                for row, k in enumerate(which.tolist()):
                    if prints[0][k] != fu[row] or prints[1][row] != fv[row]:
                        continue  # another text under a repeated id
                    a, b = left[0][left[1][k] : left[1][k + 1]], right[0][right[1][row] : right[1][row + 1]]
                    shared = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
                    ok[row] = 100 * shared >= rules.threshold * (len(a) + len(b) - shared)
                at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([u.take(at), v.take(at)], names=["u", "v"])

    links = materialize(both.mapInArrow(tidy(run), "u long, v long"), "near-links")
    discard(ids)
    return links


def set_prints(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first fingerprint of each set."""
    out = np.zeros(len(first) - 1, U64)
    full, begin = segments(first)
    if len(full):
        out[full] = np.add.reduceat(mix(sets), begin)
    return out.view(np.int64)


def _small(rows: DataFrame) -> DataFrame:
    """A table of a row per bucket, broadcast where it has few rows; else a join with it is by shuffle."""
    return F.broadcast(rows) if rows.count() <= BUCKET_ROWS else rows


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: NearRules | None = None) -> DataFrame:
    """Per row: the key, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``."""
    rules = rules or NearRules()
    bound_arrow(docs.sparkSession)
    signed = materialize(sign(docs, key, text, rules), "near-signs")
    named = signed.where("id is not null and n > 0")
    classes = named.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("other"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    classes = materialize(classes, "near-classes")

    member = classes.select("rep", "f1", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialize(member.join(full, "band"), "near-buckets")
    facts = classes.select("rep", "f1", F.struct("n", "sketch", "parity").alias("tell"))

    def confirmed(likely: DataFrame) -> DataFrame:
        """The links among pairs of classes (``u``, ``fu``, ``v``, ``fv``) whose sketches are alike."""
        likely = materialize(likely, "near-pairs")
        links = _confirm(likely, docs, key, text, rules)
        discard(likely)
        return links

    # Rows that repeat an id join the classes that they are in.
    kinds = F.struct("f1", "f2", "n")
    repeated = materialize(named.groupBy("id").agg(F.min(kinds).alias("a"), F.max(kinds).alias("b")).where("a <> b").select("id"), "near-repeated")
    roots = None
    if not repeated.isEmpty():
        classes_of = named.select("id", "f1", "f2", "n").join(repeated, "id", "left_semi").distinct().join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
        least = classes_of.groupBy("id").agg(F.min("rep").alias("u"))
        roots = components(classes_of.join(least, "id").select("u", F.col("rep").alias("v")))
    discard(repeated)

    def known(rows: DataFrame) -> DataFrame:
        """Rows of classes with the component, ``root``, that each is in so far."""
        if roots is None:
            return rows.withColumn("root", F.col("rep"))
        return rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))

    def with_links(links: DataFrame) -> DataFrame:
        joined = components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        discard(links, *[x for x in (roots,) if x is not None])
        return joined

    n_members, idle, before = buckets.count(), False, math.inf
    for turn in range(rules.rounds + 1):
        members = known(buckets.where(F.col("size") >= (2 if turn == 0 else 3))).select("band", "rep", "f1", "root")
        chosen = F.min(F.struct(F.xxhash64("band", "rep", F.lit(turn)).alias("h"), "rep", "f1", "root")).alias("p")
        if turn == 0 < rules.rounds:
            pivots = members.groupBy("band").agg(chosen, F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "p")
            pivots = materialize(pivots, "near-pivots")
        else:
            members = materialize(members, "near-members")
            parts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), chosen).groupBy("band")
            parts = parts.agg(F.max(F.struct("c", "root")).alias("largest"), F.count(F.lit(1)).alias("n_parts"), F.sum("c").alias("n"), F.min("p").alias("p"))
            parts = materialize(parts.where("n_parts > 1").select("band", F.col("largest.root").alias("main"), (F.col("n") - F.col("largest.c")).alias("n_loose"), "n", "p"), "near-parts")
            meet = parts.agg(F.sum(F.col("n_loose").cast("double") * F.col("n"))).first()[0] or 0
            if idle or turn == rules.rounds or meet <= LIGHT * n_members or 2 * meet > before:
                break
            before = meet
            pivots = parts.select("band", "p")
        # A bucket's pivot, another one each round, is compared with the members that are not yet with it.
        apart = members.join(_small(pivots), "band").where(F.col("root") != F.col("p.root"))
        pairs = apart.select(F.col("p.rep").alias("u"), F.col("p.f1").alias("fu"), F.col("rep").alias("v"), F.col("f1").alias("fv"))
        # Dealt by one side, equal pairs meet as well and the first join needs no further exchange of them.
        pairs = pairs.repartition("v", "fv").distinct()
        a = facts.select(F.col("rep").alias("u"), F.col("f1").alias("fu"), F.col("tell").alias("a"))
        b = facts.select(F.col("rep").alias("v"), F.col("f1").alias("fv"), F.col("tell").alias("b"))
        links = confirmed(pairs.join(b, ["v", "fv"]).join(a, ["u", "fu"]).where(_alike("a", "b", rules)).select("u", "fu", "v", "fv"))
        discard(*((pivots,) if turn == 0 else (members, parts)))
        idle = links.isEmpty()
        if not idle:
            roots = with_links(links)

    # What is still outside its bucket's largest component meets the rest of the bucket.
    # Both sides are cut into blocks by hash and each pair of blocks is a task's key, so large buckets are spread out.
    blocks = lambda rows: F.floor((rows - 1) / F.lit(BLOCK_ROWS)).cast("int")
    cut = parts.select("band", "main", blocks(F.col("n_loose")).alias("last_x"), blocks(F.col("n")).alias("last_y"))
    rest = members.join(_small(cut), "band").withColumn("loose", F.col("root") != F.col("main"))
    rest = materialize(rest.join(facts, ["rep", "f1"]), "near-rest")
    dealt = lambda last: F.pmod(F.xxhash64("rep", "f1"), F.col(last) + 1).cast("int")
    every = lambda last: F.explode(F.sequence(F.lit(0), F.col(last)))
    cells = shuffle_partitions(docs.sparkSession), "band", "i", "j"
    x = rest.where("loose").withColumn("i", dealt("last_x")).withColumn("j", every("last_y")).repartition(*cells).alias("x")
    y = rest.withColumn("j", dealt("last_y")).withColumn("i", every("last_x")).repartition(*cells).alias("y")
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.root") != F.col("y.root")) & (~F.col("y.loose") | (F.col("x.rep") < F.col("y.rep")))
    links = confirmed(x.join(y, meet & _alike("x.tell", "y.tell", rules)).select(F.col("x.rep").alias("u"), F.col("x.f1").alias("fu"), F.col("y.rep").alias("v"), F.col("y.f1").alias("fv")).distinct())
    discard(buckets, members, parts, rest)
    if not links.isEmpty():
        roots = with_links(links)

    of_class = known(classes.select("f1", "f2", "n", "rep")).select("f1", "f2", "n", "root")
    out = signed.select("id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"], "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    kind = docs.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))
