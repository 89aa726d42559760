"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 8000 + "x" * 50_000


def test_token_counts(spark):
    from tideline.llm.token_counts import count_tokens

    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, "x"), (2, "", None), (3, LONG, "x"), (4, LONG + "!", "x"), (4, "a b c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = count_tokens(df).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.n_pretokens, r.n_tokens))
    assert by[None] == by[2] == [(0, 0)] and by[1][0] == by[1][1] and by[1][0] in by[4]
    assert by[3][0][1] > 40_000 and dict(count_tokens(df).dtypes)["n_tokens"] == "bigint"
    assert count_tokens(df.limit(0)).count() == 0


def test_language_model_scores(spark):
    from tideline.llm.language_model import score_documents

    rows = [(1, "a b c", 0.5), (1, "a b c", 0.5), (None, "a b", 0.5), (2, None, 0.5), (3, "a b c d " * 20_000, 0.5), (7, "", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = score_documents(df, held_out=F.col("doc_id") == 3, order=3).collect()
    assert len(got) == len(rows)
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0] == ones[1] and ones[0].train_tokens == 4 + 4 + 3 + 1 + 1
    assert {r.n_tokens for r in got if r.doc_id in (2, 7)} == {1} and [r.n_tokens for r in got if r.doc_id == 3] == [80_001]
    # Nothing to learn from: every token is unknown, and all are equally likely.
    for r in score_documents(df, held_out=F.lit(True), order=3).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) and r.base_score == pytest.approx(0)


def test_byte_pairs(spark):
    from tideline.llm.bpe import encode_documents

    rows = [(1, "same", "x"), (1, "same", "x"), (None, None, "x"), (2, LONG, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(df).collect()
    assert sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows) == sorted(r.decoded_sha256 for r in got)
    assert len({r.ids_sha256 for r in got if r.doc_id == 1}) == 1 and [r.ids for r in got if r.doc_id is None] == [[]]
    assert encode_documents(df.limit(0)).count() == 0


def test_pairs_of_large_ids(tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    from tideline.llm.bpe import ByteBPE

    # Ids far apart, beyond twenty bits, so that pairs of them must not be confused.
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abcd", b"bc", b"abc"]
    ranks = {p: i * 30_011 for i, p in enumerate(pieces)}
    path = tmp_path / "wide.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for p, i in ranks.items()))
    library = tiktoken.Encoding("wide", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import numpy as np

    own = ByteBPE(str(path), P.PATTERN)
    for text in ("abcd abcabcd bcbcd", "aabbccdd dcba abc", ""):
        assert np.frombuffer(own.encode_all([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_archives_of_repeated_pages(spark, monkeypatch):
    from tideline.llm import warc
    from tideline.llm.store import new_folder

    pages = [(3, "http://a/", "same"), (3, "http://b/", "same"), (9, "http://c/", "same"), (None, "http://d/", "same"), (None, "http://e/", "alone"), (None, "http://f/", "alone"), (5, "http://g/", LONG), (6, "http://h/", LONG), (7, "http://i/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 400)
    folder = new_folder(spark, "warc")
    index = warc.write_archives(df, folder)
    assert index.select("file").distinct().count() > 2
    rows = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index, folder).collect())
    size = len(LONG)
    assert rows == collections.Counter([(3, "response", None, 4), (3, "response", None, 4), (9, "revisit", 3, 4), (None, "revisit", 3, 4), (None, "response", None, 5), (None, "response", None, 5), (5, "response", None, size), (6, "revisit", 5, size), (7, "response", None, 0)])


def test_lines(spark):
    from tideline.llm.line_dedup import clean_documents, dedup_lines

    long = "word " * 40_000 + "end"
    rows = [(None, f"{long}\nonly here in this one", "u", 1.0), (4, f"{long}\nb", "v", 2.0), (4, f"{long}\nb", "v", 2.0), (5, "word " * 40_000 + "fin", "w", 3.0), (6, None, "z", 4.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, d double")
    got = {(r.doc_id, r.text, r.gone, r.d, r.n_removed, r.n_near) for r in dedup_lines(df).collect()}
    assert got == {(4, f"{long}\nb", "v", 2.0, 0, 0), (None, "only here in this one", "u", 1.0, 1, 0), (5, "", "w", 3.0, 1, 1), (6, None, "z", 4.0, 0, 0)}
    kept = clean_documents(df)
    assert kept.columns == df.columns and kept.count() == 4


def test_near_duplicates_of_long_texts(spark):
    from tideline.llm.near_dedup import near_duplicates

    base = " ".join(f"w{i}" for i in range(60_000))
    rows = [(9, base, 1), (2, base + " more", 1), (5, base[: len(base) // 2], 1), (7, "x", 1), (7, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    half = len(base[: len(base) // 2].split())
    assert got == [(2, 59_997, 2), (5, half - 4, 5), (7, 1, 7), (7, 1, 7), (9, 59_996, 2)]


def test_workers_keep_no_caches_between_stages(monkeypatch):
    import time

    import pyarrow as pa

    from tideline.llm import bpe, store, words

    monkeypatch.setattr(store, "PAUSE", 0.2)
    bpe._loaded.clear()
    for _ in range(2):
        with bpe.lent_codec() as own:
            assert own.encode("a b") and bpe._loaded
        with bpe.lent_codec() as again:  # a task that follows at once finds it
            assert again is own
            time.sleep(0.5)
            assert bpe._loaded
        time.sleep(0.6)
        assert not bpe._loaded
        assert len(own.encode("a b")) == 2

    def run(batches):
        for batch in batches:
            yield words.words_of(batch).hashes()

    assert len(next(store.tidy(run)([pa.array(["a b c"])]))) == 3
    assert sum(x.nbytes for x in words._powers.values()) == 0
