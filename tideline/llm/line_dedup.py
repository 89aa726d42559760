"""Line deduplication across documents by a deletion-neighbourhood join.

Lines are trimmed of white space at both ends; words are what single characters
of white space separate, whichever it is. Equal lines are found by hash. Lines of at least ``near_words`` words
are also compared within an edit bound of one word: each emits, as hashed keys,
itself and all variants with one word deleted; lines that share a key are
joined, the edit distance is verified on the words, and only the earliest line
stays. "Earliest" is by document id, then place in the document.

An edit of one word leaves half a line untouched, and of four quarters all but
one, so lines that share neither half with another line, or then no three
quarters, emit nothing, and only words of a quarter whose rest is shared are
deleted: lossless cuts before the variants are made. Inside a
group of lines that share a variant every line is joined with the group's
earliest only, never with each other. Two lines that differ in one word share
the variant without it at the same place; a line with a word more has the
shorter one among its variants. These two kinds of group are kept apart, so
the earliest of a group is a true neighbour.

All of it is DataFrame code.

Cases: null texts stay null and have no lines; lines with fewer than
``least_words`` words and fewer than ``LEAST_CHARS`` characters always stay (in
scripts without spaces a long line is one word); a line of under ``near_words``
words has no near copies, as one word is more than an eighth of it; very long
lines and texts are compared whole; a null id comes after all others; rows that
repeat both id and text are one document and get equal results; an empty table
gives an empty result; other columns pass through unless their name is one of
the results' (:func:`clean_documents` returns just the input's columns,
whatever their names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import discard, materialize

#: Rows of line ids (16 bytes each) up to which they are broadcast to the scan; beyond, the same join is by shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters from which a line counts however few its words are.
LEAST_CHARS = 16
_LAST = 2**63 - 1
#: White space that is trimmed from a line's ends.
_ENDS = " \t\r\x0b\x0c"
_BLOCK = 64


def words_in(line: Column) -> Column:
    return F.split(line, " ")


def n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _prefix_xors(values: Column) -> Column:
    """The XOR of the first i values for i = 0 .. n - 1: by block, then inside the block."""
    n_blocks = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    block = F.when(n_blocks > 0, F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: _xor(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))))

    def up_to(block: Column) -> Column:
        before = F.transform(block, lambda _, b: _xor(F.slice(block, F.lit(1), b)))
        return _let(before, lambda t: F.transform(values, lambda _, i: F.element_at(t, F.floor(i / F.lit(_BLOCK)).cast("int") + 1).bitwiseXOR(_xor(F.slice(values, F.floor(i / F.lit(_BLOCK)).cast("int") * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK)))))))

    return _let(block, up_to)


def deletion_keys(words: Column) -> Column:
    """Keys of a line: place 0 is the line itself, place i the line without its word i.

    A sequence's key is the XOR of a hash of each word with its place, so all
    variants come from running XORs of the words at their own place and one
    place before it.
    """
    here = F.transform(words, lambda w, i: F.xxhash64(w, i))
    moved = F.transform(words, lambda w, i: F.xxhash64(w, i - 1))

    def keys(a: Column) -> Column:
        def with_moved(b: Column) -> Column:
            variants = _let(
                _prefix_xors(a), lambda left: _let(_prefix_xors(b), lambda skipped: _let(_xor(b), lambda total: F.transform(left, lambda x, i: F.struct(
                    x.bitwiseXOR(total).bitwiseXOR(F.element_at(skipped, i + 1)).bitwiseXOR(F.element_at(b, i + 1)).alias("key"), (i + 1).alias("place"),
                ))))
            )
            return F.concat(F.array(F.struct(_xor(a).alias("key"), F.lit(0).alias("place"))), variants)

        return _let(moved, with_moved)

    return _let(here, keys)


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word sequences differ by at most one insertion, deletion or substitution."""

    def one_more(long: Column, short: Column) -> Column:
        at = _let(F.transform(short, lambda w, i: F.when(F.element_at(long, i + 1) == w, F.lit(-1)).otherwise(i)), lambda d: F.coalesce(F.try_element_at(F.filter(d, lambda x: x >= 0), F.lit(1)), F.size(short)))
        return _let(at, lambda i: F.slice(long, i + 2, F.size(long)) == F.slice(short, i + 1, F.size(long)))

    different = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: ~same))
    return F.when(F.size(a) == F.size(b), different <= 1).when(F.size(a) == F.size(b) + 1, one_more(a, b)).when(F.size(b) == F.size(a) + 1, one_more(b, a)).otherwise(F.lit(False))


def _half_keys(line: Column, n: Column) -> Column:
    """Hashes of both halves of a line, at both lengths that a line one word longer or shorter would use."""
    sizes = [F.floor(n / F.lit(2)).cast("int"), F.floor((n - 1) / F.lit(2)).cast("int")]
    return F.array_distinct(F.array(*[x for k in sizes for x in (F.xxhash64(F.lit("first"), F.call_function("substring_index", line, F.lit(" "), k)), F.xxhash64(F.lit("last"), F.call_function("substring_index", line, F.lit(" "), -k)))]))


def _gaps(words: Column) -> Column:
    """A line without one of its quarters, at both lengths that a line one word longer or shorter would use: hash, and first and last place of the quarter."""
    n = F.size(words)

    def gap(m: Column, j: int) -> Column:
        before = F.floor(m * j / F.lit(4)).cast("int")
        after = m - F.floor(m * (j + 1) / F.lit(4)).cast("int")
        key = F.xxhash64(F.lit(j), m, F.slice(words, F.lit(1), before), F.slice(words, n - after + 1, after))
        return F.struct(key.alias("key"), (before + 1).alias("low"), (n - after).alias("high"))

    return F.array(*[gap(m, j) for m in (n, n - 1) for j in range(4)])


def lines_of(docs: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    """One row per line with enough words or characters: document (``d``, ``th``), place ``p``, ``line``, its words ``n``, hashes ``h1``, ``h2``."""
    at = F.col(f"`{text}`")
    # Most texts hold no white space but spaces, and to look for it costs far less than to translate.
    other = reduce(lambda a, b: a | b, [F.contains(at, F.lit(c)) for c in _ENDS[1:]])
    spaced = F.when(other, F.translate(at, _ENDS[1:], " " * len(_ENDS[1:]))).otherwise(at)
    source = docs.where(at.isNotNull()).select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(at).alias("th"), F.posexplode(F.split(spaced, "\n")).alias("p", "line"))
    source = source.withColumn("line", F.trim("line")).withColumn("n", n_words(F.col("line")))
    source = source.where((F.col("n") >= least_words) | (F.char_length("line") >= LEAST_CHARS))
    return source.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))})


def _shared(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose ``key`` another line has too."""
    return keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "key")


def _only(lines: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Semi-join with ids that the scan gets whole where they are few."""
    few = ids.count() <= BROADCAST_ROWS
    return lines.join(F.broadcast(ids) if few else ids, on, "left_semi")


def near_lines(docs: DataFrame, distinct: DataFrame, key: str, text: str, least_words: int, near_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """Lines (``h1``, ``h2``) that are within one word of an earlier line, and the tables to discard once they are read."""
    halves = distinct.where(F.col("n") >= near_words).select("h1", "h2", F.explode("halves").alias("key"))
    mates = materialize(_shared(halves).select("h1", "h2").distinct(), "line-mates")
    lines = _only(lines_of(docs, key, text, max(least_words, near_words)), mates, ["h1", "h2"])
    mine = lines.groupBy("h1", "h2").agg(F.min(F.struct("d", "p", "th")).alias("o"), F.first("line").alias("line"))
    whole = materialize(mine.select("h1", "h2", "o", words_in(F.col("line")).alias("words")), "line-words")
    discard(mates)

    # The quarters that a line shares the rest with another line: at most eight, and only words in them need deleting.
    gaps = whole.select("h1", "h2", F.explode(_gaps(F.col("words"))).alias("g")).select("h1", "h2", "g.key", "g.low", "g.high")
    gaps = _shared(gaps).groupBy("h1", "h2").agg(F.collect_set(F.struct("low", "high")).alias("gaps"))
    mine = materialize(whole.join(gaps, ["h1", "h2"]), "line-near")
    discard(whole)
    wanted = lambda k: (k["place"] == 0) | F.exists("gaps", lambda g: (k["place"] >= g["low"]) & (k["place"] <= g["high"]))
    emitted = mine.select(F.struct("o", "h1", "h2").alias("me"), F.explode(F.filter(deletion_keys(F.col("words")), wanted)).alias("k")).select("me", "k.key", "k.place")
    emitted = materialize(emitted, "line-variants")
    earliest = emitted.groupBy("key", "place").agg(F.min("me").alias("other"), F.count(F.lit(1)).alias("c"))
    same_size = emitted.join(earliest.where("c > 1 and place > 0").select("key", "place", "other"), ["key", "place"]).where(F.col("other") < F.col("me"))
    complete = emitted.where("place = 0").select("key", F.col("me").alias("other"))
    longer = emitted.where("place > 0").join(complete, "key").select(F.greatest("me", "other").alias("me"), F.least("me", "other").alias("other"))
    pairs = same_size.select("me", "other").unionByName(longer).groupBy("me").agg(F.min("other").alias("other"))
    words = mine.select("h1", "h2", "words")
    pairs = pairs.select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("other.h1").alias("e1"), F.col("other.h2").alias("e2"))
    pairs = pairs.join(words, ["h1", "h2"]).join(words.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("earlier")), ["e1", "e2"])
    return pairs.where(within_one_word(F.col("words"), F.col("earlier"))).select("h1", "h2"), [mine, emitted]


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 3, near_words: int = 8) -> DataFrame:
    """One row per document (``d``, ``th``) that loses lines: their places ``gone`` and how many were near copies."""
    lines = lines_of(docs, key, text, least_words)
    halves = F.when(F.col("n") >= near_words, _half_keys(F.col("line"), F.col("n")))
    lines = materialize(lines.select("d", "th", "p", "n", "h1", "h2", halves.alias("halves")), "line-places")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(F.struct("d", "p", "th")).alias("o"), F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("halves").alias("halves")
    )
    distinct = materialize(distinct, "lines")
    near, used = near_lines(docs, distinct, key, text, least_words, near_words)
    near = near.withColumn("near", F.lit(True))
    decided = distinct.select("h1", "h2", "o", "c").join(near, ["h1", "h2"], "left").where("c > 1 or near")
    decided = materialize(decided, "line-verdicts")
    discard(distinct, *used)
    gone = lines.select("d", "th", "p", "h1", "h2").join(decided, ["h1", "h2"])
    gone = gone.where(F.coalesce("near", F.lit(False)) | (F.col("o") != F.struct("d", "p", "th")))
    return gone.groupBy("d", "th").agg(F.collect_set("p").alias("gone"), F.count_if(F.coalesce("near", F.lit(False))).alias("n_near"))


RESULT_NAMES = ["n_lines", "n_removed", "n_near", "emptied"]


def _deduped(docs: DataFrame, key: str, text: str, least_words: int, near_words: int) -> DataFrame:
    """The columns of ``docs`` under the names c0, c1 ..., the text without repeated lines, then the results."""
    gone = removed_lines(docs, key, text, least_words, near_words)
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    the_key, the_text = names[docs.columns.index(key)], names[docs.columns.index(text)]
    at = F.col(the_text)
    source = own.select(*names, F.coalesce(F.col(the_key).cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64(at).alias("th"))
    joined = source.join(gone, ["d", "th"], "left")
    split = F.split(at, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    rebuilt = F.when(F.col("gone").isNull(), at).otherwise(F.array_join(_let(split, lambda s: F.transform(F.array_sort(stay), lambda i: F.element_at(s, i + 1))), "\n"))
    out = joined.select(
        *[(rebuilt if n == the_text else F.col(n)).alias(n) for n in names],
        F.when(at.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("gone").isNotNull().alias("lost"),
        F.char_length(at).alias("chars"),
    )
    left = F.trim(F.coalesce(at, F.lit("")), F.lit(_ENDS + "\n"))
    trivial = ~F.exists(F.split(left, "\n"), lambda line: n_words(F.trim(line, F.lit(_ENDS))) >= least_words)
    little = trivial & (20 * F.char_length(left) <= F.col("chars") - F.char_length(at))
    return out.select(*names, *RESULT_NAMES[:3], (F.col("lost") & ((F.char_length(left) == 0) | little)).alias("emptied"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 3, near_words: int = 8) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines``, ``n_removed``, ``n_near``, ``emptied``.

    ``emptied``: lines went, and no word is left, or only lines that are
    never removed, with at most a twentieth of the characters that went.
    """
    keep = [(i, c) for i, c in enumerate(docs.columns) if c.lower() not in RESULT_NAMES]
    return _deduped(docs, key, text, least_words, near_words).select(*[F.col(f"c{i}").alias(c) for i, c in keep], *RESULT_NAMES)


def clean_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without repeated lines and emptied documents, with its own columns only and ``n_chars`` (if there) kept true."""
    cleaned, at = _deduped(docs, key, text, 3, 8).where("not emptied"), docs.columns.index(text)
    of = lambda i, c: F.char_length(f"c{at}").cast(docs.schema[c].dataType) if c == n_chars else F.col(f"c{i}")
    return cleaned.select(*[of(i, c).alias(c) for i, c in enumerate(docs.columns)])
