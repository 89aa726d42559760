"""Deduplication, decontamination, pages and archives, against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

SPACE = re.compile("[\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def copies(seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(12):
        base = r.choices(vocabulary, k=r.randint(6, 80))
        for _ in range(r.randint(1, 6)):
            w = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return out + [None, "", "one two", "ONE  two", "three"]


def test_components(spark):
    from tideline.llm.components import components

    r = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 30)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)] + [(500, 500 + k) for k in range(1, 60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def settled(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("most", [4, 1000])
def test_components_over_many_tasks(spark, monkeypatch, most):
    from tideline.llm import components as C

    # A task may contract whole parts at once, or only a few edges.
    monkeypatch.setattr(C, "MOST_EDGES", most)
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(150)] + [(-k, -7) for k in range(200, 230)] + [(1000 + r.randrange(90), 1000 + r.randrange(90)) for _ in range(80)]
    edges += [(5000 - k, 5001 - k) for k in range(0, 80, 2)] + [(2**62, -(2**62)), (3000, 3000)]
    r.shuffle(edges)
    got = C.components(spark.createDataFrame(edges, "u long, v long").repartition(24)).collect()
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.root for x in got} == settled(edges)


def test_stars_by_hash():
    import numpy as np

    from tideline.llm.components import stars

    edges = [(k, k + 1) for k in range(50)] + [(100, 90), (95, 90), (7, 7), (200, 200)]
    u, v = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    same = collections.defaultdict(set)
    for node, first in zip(*(x.tolist() for x in stars(u, v, 12345)), strict=True):
        same[first].add(node)
    assert sorted(map(sorted, same.values())) == [list(range(51)), [90, 95, 100], [200]]
    assert all(first in group for first, group in same.items()) and set(same) != {0, 90, 200}


def tasks_of(spark, run):
    """Tasks of the jobs of ``run``, with 16 partitions in each exchange."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    context, group = spark.sparkContext, f"tasks-{random.random()}"
    for k, x in conf.items():
        spark.conf.set(k, x)
    context.setJobGroup(group, group)
    try:
        out = run()
        seen = context.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
        return out, sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, x in old.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def test_components_take_few_exchanges(spark):
    from tideline.llm.components import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 200)]
    got, n = tasks_of(spark, lambda: components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect())
    assert {x.node: x.root for x in got} == settled(edges)
    assert n <= 550


def test_rounds_end_when_they_gain_nothing(spark):
    from tideline.llm.near_dedup import near_duplicates

    # Chains of copies that drift, and unlike texts that share buckets: each round finds some links, all of them few.
    r = random.Random(8)
    texts = []
    for k in range(12):
        words = [f"c{k}w{i}" for i in range(60)]
        for step in range(8):
            texts.append(" ".join(words))
            words[5 + 6 * step] = f"c{k}x{step}"
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"d{k}v{i}" for i in range(25)) for k in range(40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, n = tasks_of(spark, lambda: {x.doc_id: x.component_id for x in near_duplicates(docs).collect()})
    assert got == {i: i // 8 * 8 if i < 96 else i for i, _ in rows}
    assert n <= 700


def test_near_duplicates(spark):
    from tideline.llm.near_dedup import near_duplicates

    texts = copies()
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[0], 0), (3, "another text under a repeated id and more", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    sets = collections.defaultdict(list)
    for i, t, _ in rows:
        w = [x for x in SPACE.split((t or "").translate(LOWER)) if x]
        s = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
        if i is not None:
            sets[i].append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == find(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    from tideline.llm.near_dedup import near_duplicates

    r = random.Random(9)
    rows, near = [], 0
    for k in range(300):
        base = [f"t{k}w{i}" for i in range(r.randint(60, 200))]
        copy = base[:]
        # An edit inside a text takes five shingles on either side.
        for at in r.sample(range(0, len(base), 6), max(1, round(len(base) * r.uniform(0.014, 0.027)))):
            copy[at] = "x"
        s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        share = len(s & t) / len(s | t)
        if share < 0.86:
            rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
            near += 0.75 <= share
    linked = sum(x.doc_id != x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert near > 100 and linked == near


def test_a_bucket_of_unlike_texts_in_blocks(spark, monkeypatch):
    from tideline.llm import near_dedup as N

    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"{shared} " + " ".join(f"d{k}v{i}" for i in range(25)) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " more") for k, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_near_copy_of_a_repeated_ids_second_text(spark):
    from tideline.llm.near_dedup import near_duplicates

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(5, a), (5, b), (9, b + " more"), (8, a + " more"), (6, d), (6, c), (7, c + " more"), (4, d + " more")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (9, 5), (8, 5), (6, 4), (7, 4), (4, 4)}


def test_deletion_keys(spark):
    from tideline.llm.line_dedup import deletion_keys, within_one_word

    r = random.Random(2)
    rows = [([r.choice("abc") for _ in range(r.randrange(6))], [r.choice("abc") for _ in range(r.randrange(6))]) for _ in range(60)] + [(list("abc") * 60, list("abc") * 59 + list("ab"))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    keys = {}
    for x in df.select("a", "b", within_one_word(F.col("a"), F.col("b")).alias("near"), deletion_keys(F.col("a")).alias("k")).collect():
        assert x.near == (edits(x.a, x.b) <= 1)
        for k in x.k:
            left = tuple(x.a) if k.place == 0 else tuple(x.a[: k.place - 1] + x.a[k.place :])
            assert keys.setdefault(left, k.key) == k.key
    assert len(set(keys.values())) == len(keys)


def test_line_dedup(spark):
    from tideline.llm.line_dedup import dedup_lines

    r = random.Random(6)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 14))) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randrange(0, 5)):
            w = r.choice(pool).split(" ")
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["zz"], [w[k], "yy"]])
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (5, rows[5][1])]
    got = {(x.doc_id, x.text, x.n_removed) for x in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for i, t in sorted({x for x in rows if x[1]}):
        for p, line in enumerate(t.split("\n")):
            w = tuple(line.split(" "))
            if len(w) >= 3:
                first.setdefault(w, (i, p))
    near = {w for w in first if len(w) >= 8 and any(len(v) >= 8 and first[v] < first[w] and edits(v, w) <= 1 for v in first)}
    for i, t in rows:
        if t is None:
            assert (i, None, 0) in got
            continue
        keep = [line for p, line in enumerate(t.split("\n")) if len(line.split(" ")) < 3 or (tuple(line.split(" ")) not in near and first[tuple(line.split(" "))] == (i, p))]
        assert (i, "\n".join(keep), len(t.split("\n")) - len(keep)) in got
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lines_of_few_words(spark):
    from tideline.llm.line_dedup import dedup_lines

    lines = ["日本語の長い行がここに一つだけあります", "one\ttwo\tthree", "no\u00a0break\u00a0spaces\u00a0here", "a b c d e f g h i"]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:3], "a\tb\tc\td\te\tf\tg\th\tz", "short one"]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("short one", 4)}


def test_documents_of_short_lines_are_not_emptied(spark):
    from tideline.llm.line_dedup import dedup_lines

    footer = "all rights reserved by us"
    rows = [(1, footer), (2, f"apple\nred pear\n{footer}"), (3, f"{footer}\n \t")]
    got = {r.doc_id: (r.text, r.emptied) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (footer, False), 2: ("apple\nred pear", False), 3: (" \t", True)}


def test_leaks(spark):
    from tideline.llm.decontaminate import find_leaks

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choices("aeioustrnl", k=r.randint(2, 7))) for _ in range(n))
    items = [(k, prose(r.randint(15, 60))) for k in range(20)] + [(90, None), (91, "ab")]

    def changed(text, n):
        chars = list(text)
        for _ in range(n):
            chars[r.randrange(len(chars))] = r.choice("xyz")
        return "".join(chars)

    docs = [(100 + k, prose(50) + " " + changed(t, int(0.05 * len(t))).upper().replace(" ", "\n  ") + " " + prose(40)) for k, t in items[:20]] + [(200 + k, prose(150)) for k in range(30)] + [(300, None), (301, ""), (302, items[3][1] * 200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(100 + k, k) for k in range(20)} | {(302, 3)}
    assert find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench.limit(0)).count() == 0


def test_parts_of_items_and_short_items(spark):
    from tideline.llm.decontaminate import find_leaks

    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choices("aeioustrnl", k=r.randint(2, 7))) for _ in range(n))
    item = prose(70)[:253]
    parts = {1: item[30:165], 2: item[:110], 3: item[150:220], 4: item[100:140], 5: item[64:199], 8: item[77:141], 9: item[77:118]}
    docs = [(k, f"{prose(40)} {t} {prose(40)}") for k, t in parts.items()] + [(6, prose(30) + " zq7 " + prose(9)), (7, prose(30) + " zq72 " + prose(9)), (10, "是短短短短题目吗"), (11, prose(9000) + item)]
    docs += [docs[0]]
    for kind, own in (("long", int), ("int", int), ("string", str)):
        items = [(own(1), item, "x"), (own(2), "zq7", "x"), (own(3), " ", "x"), (own(4), None, "x"), (None, item, "x"), (own(5), "短短短题", "x"), (own(1), "zq7", "x")]
        df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, edits int, item_id int")
        found = find_leaks(df, spark.createDataFrame(items, f"item_id {kind}, text string, start string"))
        got = collections.Counter((x.doc_id, x.item_id) for x in found.collect())
        assert got == collections.Counter([(k, own(1)) for k in (1, 1, 2, 3, 5, 6, 8, 11)] + [(6, own(2)), (10, own(5))])
        assert find_leaks(df.limit(0), spark.createDataFrame(items, f"item_id {kind}, text string, start string")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcde"])
def test_every_window_within_the_bound_is_found(letters):
    from tideline.llm import decontaminate as D

    r = random.Random(letters)
    rules = D.LeakRules(q=6, passage=24)

    def off(window, text):
        """Least edits between a window and any part of a text."""
        row = [0] * (len(text) + 1)
        for i, x in enumerate(window, 1):
            last, row = row, [i]
            for j, y in enumerate(text, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return min(row)

    items = ["".join(r.choices(letters, k=n)) for n in (1, 4, 9, 10, 11, 15, 19, 20, 23, 24, 25, 30, 39, 47, 48, 60)]
    texts = []
    for item in items * 2:
        part = list(item[r.randrange(max(1, len(item) // 3)) :])
        for _ in range(r.choice([0, 1, 2, 2, 3, 4])):
            if part:
                at = r.randrange(len(part))
                part[at : at + 1] = r.choice([[], [r.choice(letters)], [part[at], r.choice(letters)]])
        texts.append("".join(r.choices(letters, k=r.randrange(12))) + "".join(part) + "".join(r.choices(letters, k=r.randrange(12))))
    for together in (texts, *[[t] for t in texts[:4]]):
        found = D.find_leaks_in(together, D.ItemIndex.build(items, rules))
        got = {(d, i) for d, i, *_ in found}
        for i, item in enumerate(items):
            if len(item) < 10:
                continue
            sizes = {min(len(item), 24), len(item) if len(item) < 48 else 24}
            windows = {item[s : s + size] for size in sizes for s in range(len(item) - size + 1)}
            for d, text in enumerate(together):
                assert ((d, i) in got) == any(off(w, text) <= len(w) // 10 for w in windows), (item, text)
        for d, i, start, end, k in found:
            assert min(edits(items[i][s : s + size], together[d][start:end]) for size in {len(items[i]), 24} for s in range(max(1, len(items[i]) - size + 1))) <= k


def test_pieces_of_many_shared_grams(monkeypatch):
    from tideline.llm import decontaminate as D

    r = random.Random(5)
    item = "".join(r.choices("abcdefgh", k=200))
    texts = ["a" * 3000 + item[20:150] + "b" * 500, "".join(r.choices("abcdefgh", k=900)), item * 3, "a" * 70]
    index = D.ItemIndex.build([item, "a" * 90, item[:70]], D.LeakRules())
    want = D.find_leaks_in(texts, index)
    assert {(d, i) for d, i, *_ in want} == {(0, 0), (0, 1), (2, 0), (2, 2), (3, 1)}
    monkeypatch.setattr(D, "_HITS", 50)
    monkeypatch.setattr(D, "_CELLS", 100)
    assert {(d, i) for d, i, *_ in D.find_leaks_in(texts, index)} == {(d, i) for d, i, *_ in want}


def test_alignment():
    import numpy as np

    from tideline.llm.decontaminate import align, codes, gram_hashes

    r = random.Random(3)
    outside = np.full(12, 0xFFFFFFFF, np.uint32)
    for _ in range(30):
        text = "".join(r.choices("ab", k=40))
        item = "".join(r.choices("ab", k=12))
        best = min(edits(item, text[a:b]) for a in range(41) for b in range(a, 41))
        found, start, end = (int(x[0]) for x in align(codes(item)[None], np.concatenate((outside, codes(text), outside))[None]))
        assert found == best and edits(item, text[max(0, start - 12) : max(0, end - 12)]) == best
    a, b = codes("xabcdefghy"), codes("abcdefgh")
    assert gram_hashes(a, 8)[1] == gram_hashes(b, 8)[0] and len(gram_hashes(b, 9)) == 0


def test_url_rules(spark):
    from tideline.llm.url_rules import filter_urls, site_rule, word_rule

    sites = [site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow")]
    cases = {
        "http://a.example.net/en/1?x=/": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://X.NET/": ("x.net", "/", "net/", "block"), "https://x.net": ("x.net", "", None, "allow"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "http://example.com/de/#f": ("example.com", "/de/", "example.com/de/", "block"), "http://example.com/DE/": ("example.com", "/DE/", None, "allow"),
        "http://q.org/fr/a://b": ("q.org", "/fr/a://b", "org/fr/", "allow"), "http://casino-win.example.org/en": ("casino-win.example.org", "/en", None, "block"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://casino.org/fr/": ("casino.org", "/fr/", "org/fr/", "allow"), "http://ads.example.net/en/": ("ads.example.net", "/en/", "example.net/en/", "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    rows = {r.url: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, sites).collect()}
    assert rows == cases
    assert filter_urls(df, [], []).where("verdict = 'allow'").count() == len(cases)
    assert filter_urls(df.limit(0), sites, [word_rule("a")]).count() == 0


def test_many_url_rules(spark, monkeypatch):
    from tideline.llm import url_rules as U

    r = random.Random(7)
    sites = {f"s{k}.t{k % 400}.{r.choice(['com', 'net'])}/" + r.choice(["", "a/", "a", "b-c/"]): r.choice(["allow", "block"]) for k in range(50_000)}
    names = list(sites)
    urls = [f"https://{r.choice(['', 'www.', 'x'])}{s.rstrip('/')}{r.choice(['', '/', '/1?q', 'z#f'])}" for s in r.choices(names, k=300)] + [None, "", "HTTP://s1.T1.com/a", f"http://h.com/{'y' * 200_000}"] * 2
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    extra = [U.UrlRule("digits", r"[0-9]{3}\.t", "block", ())]

    def expected(url):
        if not url or "://" not in url:
            return None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0].lower()
        path = re.split("[?#]", rest[len(host) :])[0]
        labels, found = host.split("."), []
        for k in range(len(labels)):
            site = ".".join(labels[k:])
            found += [s for s in (f"{site}{path[:n]}" for n in range(1, min(len(path), 9) + 1)) if s in sites]
        if found:
            best = max(found, key=lambda s: (len(s), s))
            return best, sites[best]
        return None, "block" if re.search(r"[0-9]{3}\.t", url.lower()) else "allow"

    for most in (10**9, 0):
        monkeypatch.setattr(U, "BROADCAST_BYTES", most)
        rows = U.filter_urls(df, [U.site_rule(s, v) for s, v in sites.items()], extra).collect()
        assert {x.page_id: (x.rule, x.verdict) for x in rows} == {i: expected(u) for i, u in enumerate(urls)}


def test_filter_lists():
    from tideline.llm.url_rules import filter_rule

    rule = lambda line: filter_rule(line)
    assert [rule(x) for x in ("! note", "[Adblock]", "a##b", "x$third-party", "")] == [None] * 5
    for line, yes, no in [
        ("||ads.example^", ["http://ads.example/", "https://x.ads.example:80/a", "http://ads.example"], ["http://ads.example.org/", "http://badads.example/"]),
        ("/banner/*/img^", ["http://h/banner/1/img?x", "http://h/a/banner/2/img"], ["http://h/banner/img", "http://h/banner/1/images"]),
        ("|http://start", ["http://start.org/"], ["https://h/http://start"]), (".swf|", ["http://h/a.swf"], ["http://h/a.swf?1"]), ("@@||good.org^", ["http://good.org/"], ["http://good.orgs/"]),
    ]:
        found = rule(line)
        assert found.verdict == ("allow" if line.startswith("@@") else "block")
        for url in yes + no:
            assert bool(re.search(found.pattern, url)) == (url in yes), (line, url)
        assert all(t in re.split("[^a-z0-9]+", url) for url in yes for t in found.tokens), found


def test_archives(spark):
    from tideline.llm.store import new_folder
    from tideline.llm.warc import digest_of, read_records, write_archives

    pages = [(5, "http://a/é b\r\n", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://c/", None), (4, "http://d/", ""), (7, "http://e/", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://f/", "<p>same</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int")
    folder = new_folder(spark, "warc")
    index = write_archives(df, folder)
    rows = {r.page_id: r for r in read_records(index, folder, payloads=True).collect()}
    assert len(rows) == len(pages) == index.count()
    for number, url, html in pages:
        r, payload = rows[number], (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), digest_of(payload))
        assert r.record_type == "revisit" or bytes(r.payload) == payload
    assert {k: r.refers_to for k, r in rows.items()} == {5: 3, 3: None, 9: 4, 4: None, 7: None, None: 3}
    assert read_records(index.where("page_id = 7"), folder).first().payload_bytes == len(pages[4][2].encode())
    big = new_folder(spark, "warc")
    assert read_records(write_archives(df, big, least_bytes=5), big).where("record_type = 'revisit'").count() == 2
    assert read_records(write_archives(df.limit(0), big), big).count() == 0


@pytest.fixture(scope="module")
def model():
    from tideline.llm.html_extract import train

    return train(300)


def test_page_classifier_on_held_out_layouts(model):
    from tideline.llm.html_extract import extract_texts
    from tideline.llm.html_grammar import MARK, labelled_pages
    from tideline.llm.html_tree import plant

    pages = labelled_pages(60, seed=123)
    want = ["\n".join(t.replace(MARK, "") for t in plant([p]).texts if t and MARK in t) for p in pages]
    got = extract_texts([p.replace(MARK, "") for p in pages], model)
    right = sum((collections.Counter(a.split("\n")) & collections.Counter(b.split("\n"))).total() for a, b in zip(want, got, strict=True))
    assert right / sum(len(a.split("\n")) for a in want) > 0.95
    assert right / sum(len(b.split("\n")) for b in got) > 0.9


def test_pages(spark, model):
    from tideline.llm.html_extract import extract

    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   paragraph\nhere, with <a href='/x'>a link</a> and text.</p><script>var x='<p>no</p>'</script><p>Second one &eacute;.<div class=ad>Buy this now.</div></article><footer>&copy; 2024 site</footer></body>"
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, "<" * 3000, "t"), (5, "<div>" * 3000, "t")], "page_id long, html string, text string")
    rows = {r.page_id: r for r in extract(df, model=model).collect()}
    assert rows[1].text == "A & B\nFirst paragraph here, with a link and text.\nSecond one é."
    assert rows[1].n_chars == len(rows[1].text) and (rows[2].text, rows[3].text) == ("", "")
    assert extract(df.limit(0), model=model).count() == 0


def test_labels_agree_along_paths(model):
    import numpy as np

    from tideline.llm.html_extract import decode
    from tideline.llm.html_grammar import labelled_pages
    from tideline.llm.html_tree import plant

    trees = plant(labelled_pages(20, seed=5))
    chosen = decode(trees, np.random.default_rng(0).normal(size=len(trees.parent)))
    inner = np.flatnonzero(trees.parent >= 0)
    assert not (chosen[inner] & ~chosen[trees.parent[inner]]).any()
    has_child = np.bincount(trees.parent[inner][chosen[inner]], minlength=len(chosen)) > 0
    assert (has_child | (trees.group == 0))[chosen].all()
