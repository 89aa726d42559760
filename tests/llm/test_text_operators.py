"""Corpus operators on texts, against brute force and public libraries."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

SPACE = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "a", "É", "word " * 3000, "The cat sat on the mat. " * 2, "x" * 5000, "a\x0bb\x0cc\rd\u00a0e", "日本語 テキスト " * 30, "🙂 naïve\x00 café"]


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, texts):
    rows = [(i, t, "en", "s", None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def made_texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghé", k=r.randint(1, 5))) for _ in range(120)]
    return [" ".join(r.choices(vocabulary, k=r.randint(1, 120))) for _ in range(n)]


def test_words_and_hashes():
    import pyarrow as pa

    from tideline.llm.words import words_of

    texts = ODD + made_texts()
    found = words_of(pa.array(texts))
    raw = found.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(found.start[x:y], found.end[x:y], strict=True)] for x, y in itertools.pairwise(found.first)]
    assert got == [words(t) for t in texts]
    by_hash = collections.defaultdict(set)
    for h, w in zip(found.hashes().tolist(), itertools.chain(*got), strict=True):
        by_hash[h].add(w.translate(LOWER))
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({w.translate(LOWER) for ws in got for w in ws})


def test_quality_counts(spark):
    from tideline.llm.quality import judge

    texts = ODD + made_texts() + ["one two\none two\n\nthree\none two", "a b c d e f g h " * 4, "#$ %& |<> *a*"]
    rows = {r.doc_id: r for r in judge(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, r = t or "", rows[i]
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)
        assert r.score == "x"
    assert judge(documents(spark, texts).limit(0)).count() == 0


def plain_figures(pieces, text):
    """Characters per token, byte share, entropy and evenness of a text, one token at a time."""
    ws = words(text)
    tokens = [t for w in ws for t in pieces.encode(w)]
    n = len(tokens)
    entropy = -sum(k / n * math.log2(k / n) for k in collections.Counter(tokens).values()) if n else 0.0
    return sum(map(len, ws)) / max(n, 1), sum(pieces.is_byte(t) for t in tokens) / max(n, 1), entropy, entropy / math.log2(max(min(n, 512), 2)), n


def test_fertility_decides(spark):
    import public_tokenizers as P
    import sentencepiece

    from tideline.llm.quality import QualityRules, judge

    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = "The river runs through the old town and its market where people meet to talk about the weather and the harvest of the year "
    texts = ODD + made_texts() + [plain * 2, plain, "qzxj kvbw xqzj " * 9 + "a b c d e f", "𐍈𐍊 ᚠᚢ ꙮꙬ ⵣⵥ " * 3 + " ".join(f"ᚠ{chr(0x16A0 + k)}ꙮ" for k in range(30)), " ".join("ab"[k % 2] for k in range(20)) + " " + " ".join("cd"[(k * k) % 3 % 2] for k in range(80))]
    langs = ["en", None, "xx", "ru"] * 17 + ["en"] * 9
    rules = QualityRules(fitted={("en", 2): (2.0, 3.5, 0.02, 0.6, 1.1), ("en", 3): (3.0, 3.5, 0.02, 0.7, 1.1), ("latin", 2): (2.5, 5.0, 0.1, 0.5, 1.1)})
    df = spark.createDataFrame([(i, t, langs[i], "u") for i, t in enumerate(texts)], "doc_id long, text string, lang string, Kept string")
    rows = judge(df, rules).collect()
    assert "Kept" not in df.sparkSession.createDataFrame(rows).columns
    kinds = collections.Counter()
    for r in rows:
        t = texts[r.doc_id]
        fertility, share, entropy, even, n = plain_figures(pieces, t)
        assert r.n_tokens == n
        assert (r.chars_per_token, r.byte_share, r.token_entropy, r.evenness) == pytest.approx((fertility, share, entropy, even))
        lang = langs[r.doc_id]
        band = rules.fitted.get((lang or r.script, int(math.log(max(n, 1), 4) + 1e-9))) or rules.bands.get(lang) or rules.bands[r.script]
        outside = {"low": fertility < band[0], "high": fertility > band[1], "bytes": share > band[2], "uneven": n >= 30 and even < band[3], "even": n >= 30 and even > band[4]}
        assert r.kept == (not r.base_failed and not any(outside.values()))
        kinds.update(k for k, v in outside.items() if v and not r.base_failed)
    assert {"low", "high", "bytes", "uneven"} <= set(kinds), kinds


def test_bands_from_labels(spark, sf):
    from tideline.llm.quality import QualityRules, fit_bands, judge, keep_good

    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rules = fit_bands(docs, labels)
    good = labels.where("quality = 1")
    figures = [r for r in judge(docs.join(good, "doc_id", "left_semi")).where("not base_failed and lang = 'en'").collect() if 64 <= r.n_tokens < 256 * 4]
    for c, least, most in ((3, 64, 256), (4, 256, 1024)):
        own = [r for r in figures if least <= r.n_tokens < most]
        low, high, _, even_low, even_high = rules.fitted["en", c]
        assert (low + high) / 2 == pytest.approx(np.mean([r.chars_per_token for r in own]))
        assert (even_low + even_high) / 2 == pytest.approx(np.mean([r.evenness for r in own]))
    # Held out: bands from half of the labels part the other half.
    half = fit_bands(docs, labels.where("doc_id % 2 = 0"))
    found = {r.doc_id: r for r in judge(docs, half).where("not base_failed").collect()}
    kept = {q: [found[r.doc_id].kept for r in labels.where(f"quality = {q} and doc_id % 2 = 1").collect() if r.doc_id in found] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.95 and np.mean(kept[0]) < 0.4
    assert fit_bands(docs, labels.limit(0)).fitted == {} == fit_bands(docs.limit(0), labels).fitted
    assert fit_bands(docs, labels, most_rows=1).fitted == {}
    odd = docs.limit(50).withColumnRenamed("n_chars", "Kept").withColumnRenamed("source", "a.b")
    assert keep_good(odd).columns == odd.columns and keep_good(odd).count() == judge(odd).where("kept").count()
    assert QualityRules().fitted == {}


def test_bpe_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    from tideline.llm.bpe import codec, encode_documents

    own = codec()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    r = random.Random(5)
    texts = ODD + made_texts() + ["".join(r.choices("ab \n\t1é漢🙂A_-'s", k=r.randint(0, 80))) for _ in range(200)] + ["ab" * 4000, " " * 999, "<|endoftext|>"]
    rows = {x.doc_id: x for x in encode_documents(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_token_counts_are_the_best_segmentation(spark):
    import public_tokenizers as P
    import regex

    from tideline.llm.token_counts import count_tokens, rank_scores

    scores = rank_scores(P.path("byte_bpe_50k.tiktoken"))

    def best(token):
        table = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            table.append(max((table[b][0] + scores[token[b:end]], -table[b][1] - 1) for b in range(max(0, end - 128), end) if token[b:end] in scores))
            table[-1] = table[-1][0], -table[-1][1]
        return table[-1][1]

    texts = ODD[:5] + made_texts(n=12) + ["a" * 300]
    rows = {r.doc_id: r for r in count_tokens(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        pieces = regex.findall(P.PATTERN, t or "")
        assert (rows[i].n_pretokens, rows[i].n_tokens) == (len(pieces), sum(best(p.encode()) for p in pieces))


def test_language_model(spark):
    from tideline.llm import language_model as M

    texts = made_texts(n=80) + [None, "", "new unseen words only"]
    rows = {r.doc_id: r for r in M.score_documents(documents(spark, texts)).collect()}
    tokens = [[w for w in words((t or "").translate(LOWER))] + [None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for i in train for w in tokens[i])
    pairs = collections.Counter(p for i in train for p in zip([None] + tokens[i][:-1], tokens[i], strict=True))
    n, v = sum(c.values()), len(c)
    followers, before = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), k in pairs.items():
        followers[a][min(k, 3) - 1] += 1
        before[b] += 1
    tally, low_tally = collections.Counter(pairs.values()), collections.Counter(before.values())
    high, low = M.discounts(*[tally[k] for k in (1, 2, 3, 4)]), M.discounts(*[low_tally[k] for k in (1, 2, 3, 4)])
    rest = sum(low[min(k, 3)] for k in before.values()) / len(pairs)

    def p(a, b):
        lower = max(before[b] - low[min(before[b], 3)], 0) / len(pairs) + rest / (v + 1)
        if not c[a]:
            return lower
        return max(pairs[a, b] - high[min(pairs[a, b], 3)], 0) / c[a] + sum(x * y for x, y in zip(followers[a], high[1:], strict=True)) / c[a] * lower

    assert sum(p(None, w) for w in [*c, "?"]) == pytest.approx(1)
    for i, ws in enumerate(tokens):
        assert rows[i].held_out == (i not in train) and rows[i].train_tokens == n
        assert (rows[i].n_tokens, rows[i].n_known) == (len(ws), sum(c[w] > 0 for w in ws))
        assert rows[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert rows[i].score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([None] + ws[:-1], ws, strict=True)))
    assert M.score_documents(documents(spark, texts).limit(0)).count() == 0


def test_language_model_of_order_3(spark):
    from tideline.llm import language_model as M

    texts = made_texts(n=60) + [None, "", "new unseen words only", "the cat sat", "the cat ran", "a the cat sat"]
    rows = {r.doc_id: r for r in M.score_documents(documents(spark, texts), order=3).collect()}
    tokens = [words((t or "").translate(LOWER)) + [None] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    vocabulary = {w for i in train for w in tokens[i]}
    grams = {n: collections.Counter(tuple(([None] + tokens[i])[k : k + n]) for i in train for k in range(len(tokens[i]) + 2 - n)) for n in (2, 3)}
    counts = {3: grams[3], 2: collections.Counter(g[1:] for g in grams[3]), 1: collections.Counter(g[1:] for g in grams[2])}
    counts[2].update({g: k for g, k in grams[2].items() if g[0] is None})
    assert set(counts[2]) == set(grams[2])
    cuts = {n: M.discounts(*[list(c.values()).count(k) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    after = {n: collections.defaultdict(list) for n in counts}
    for n, c in counts.items():
        for g, k in c.items():
            after[n][g[:-1]].append(k)

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / (len(vocabulary) + 1)
        found = after[n].get(gram[:-1])
        if not found:
            return lower
        k = counts[n][gram]
        return max(k - cuts[n][min(k, 3)], 0) / sum(found) + sum(cuts[n][min(x, 3)] for x in found) / sum(found) * lower

    for context in [(None,), (None, "the"), ("the", "cat"), grams[3].most_common(1)[0][0][:2]]:
        assert sum(p((*context, w)) for w in [*vocabulary, "?"]) == pytest.approx(1)
    for i, ws in enumerate(tokens):
        padded = [None, *ws]
        assert rows[i].score == pytest.approx(sum(math.log10(p(tuple(padded[max(0, k - 2) : k + 1]))) for k in range(1, len(padded))))
    assert M.score_documents(documents(spark, texts).limit(0), order=3).count() == 0
    one = documents(spark, ["a b", "a b"])
    assert M.score_documents(one, held_out=M.F.lit(True), order=3).count() == 2


def test_texts_are_read_once_per_count(spark):
    """Words, pairs and each part of the triples take a reading; what precedes a pair is counted from the triples."""
    from tideline.llm import language_model as M

    texts, read = made_texts(n=40), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    M.fit(documents(spark, texts).select("text").mapInArrow(seen, "text string"), order=3)
    assert read.value == (2 + M.PASSES) * len(texts)


def test_trigrams_in_many_runs(spark, monkeypatch):
    from tideline.llm import language_model as M

    texts = made_texts(n=40) + [None, "", *["a b", "c a b"] * 300]
    want = {r.doc_id: r.score for r in M.score_documents(documents(spark, texts), order=3).collect()}
    monkeypatch.setattr(M, "MOST_KEYS", 50)
    got = {r.doc_id: r.score for r in M.score_documents(documents(spark, texts), order=3).collect()}
    assert got == want


def test_a_shard_is_one_file(spark, tmp_path, monkeypatch):
    """A worker maps the files of all shards: of words, their figures, pairs, triples, what follows and what precedes a pair."""
    import pyarrow.fs

    from tideline.llm import language_model as M

    model = M.fit(documents(spark, made_texts(n=40)), shards=5, folder=str(tmp_path), order=3)
    assert len([p for p in tmp_path.iterdir() if p.suffix != ".crc"]) == 6 * 5 == len(model.words.names) * 6
    arrays = [np.arange(n, dtype=kind) for n, kind in ((3, np.uint8), (0, np.int64), (5, np.uint32), (2, np.complex128), (7, np.uint64))]
    for folder in (str(tmp_path), f"file://{tmp_path}", "elsewhere"):
        if folder == "elsewhere":
            monkeypatch.setattr(M.Files, "__init__", lambda files, _: vars(files).update(store=pyarrow.fs.LocalFileSystem(), root=f"{tmp_path}/other"))
        M.store(folder, "arrays", *arrays)
        for got, want in zip(M.load(folder, "arrays"), arrays, strict=True):
            assert got.dtype == want.dtype and (got == want).all()


def test_narrow_counts(tmp_path):
    from tideline.llm import language_model as M

    r = np.random.default_rng(7)
    rows = r.choice([0, 1, 254, 255, 256, 10**6], (40, 3))
    M.store(str(tmp_path), "rows", *M.narrow(rows.ravel()))
    flat = M.Narrow(*M.load(str(tmp_path), "rows"))
    for a, b in ((0, 120), (7, 7), (11, 90), (119, 120)):
        assert (flat.span(a, b) == rows.ravel()[a:b]).all()
    places = np.array([0, 3, 4, 39])
    figures = M.Figures(str(tmp_path), ["rows"], [40], 3)
    assert (figures.at(places) == rows[places]).all() and figures.at(places[:0]).shape == (0, 3)


def test_keys_of_more_than_64_bits(spark, monkeypatch):
    from tideline.llm import language_model as M

    texts = made_texts(n=40) + [None, "", "the cat sat", "the cat ran"]
    want = {r.doc_id: r.score for r in M.score_documents(documents(spark, texts), order=3).collect()}
    monkeypatch.setattr(M, "KEY_BITS", 4)
    assert M.Mixing.of(500).packing.wide
    for order in (3, 2):
        got = {r.doc_id: r.score for r in M.score_documents(documents(spark, texts), order=order).collect()}
        assert (got == pytest.approx(want)) == (order == 3)
    r = np.random.default_rng(3)
    left, right = r.integers(0, 2**40, (2, 2000))
    wide = M.Mixing(M.Packing(41, 41, True))
    back = wide.unmixed(wide.mixed(left, right))
    assert (back[0] == left).all() and (back[1] == right).all()
    cuts = wide.ranges(7)
    keys = np.sort(wide.mixed(left, right))
    sizes = [b - a for a, b in (M.span_of(keys, low, high) for _, low, high in cuts)]
    assert sum(sizes) == 2000 and min(sizes) > 200


def test_op6_scores_by_two_words_of_context(spark, sf):
    from tideline.llm import language_model as M
    from tideline.llm.queries import op6_lm_scoring

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, want = ({r.doc_id: r.score for r in df.collect()} for df in (op6_lm_scoring(spark, sf), M.score_documents(docs, order=3)))
    assert got == pytest.approx(want)


def test_discounts_without_counts():
    from tideline.llm.language_model import discounts, mix, unmix

    assert all(0 <= d <= c for c, d in enumerate(discounts(0, 0, 0, 0)))
    x = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    assert (unmix(mix(x)) == x).all()
