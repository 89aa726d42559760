"""Main text of web pages: boosted trees over DOM nodes, decoded as a hierarchy.

Each node of a page's block tree gets features of its subtree (text, links,
punctuation, tags), of its attribute words, of its depth and ancestors and of
its siblings. A classifier of gradient-boosted trees gives the log-odds that
the node holds article text. Since a node holds some exactly if one of its
blocks is some, labels must agree along every path; the decoder picks the most
likely set of labels among those that do, by dynamic programming from the
leaves up, so no block is kept inside a rejected ancestor and no container is
kept for nothing.

The classifier is trained on ``TRAIN_PAGES`` labelled pages made by a fixed
grammar of common page layouts; nothing is learnt from the table.

Cases: a null page, or one without article text, gives an empty text; very long
and very deep pages are read whole, in linear time; pages are judged one by
one, so repeated rows get equal results; of label sets that tie the one with
fewer nodes is taken; an empty table gives an empty result; other columns pass
through unless their name is one of the results'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import boosting
from tideline.llm.html_tree import COUNTS, GROUP_NAMES, Forest, plant
from tideline.llm.store import bound_arrow, tidy
from tideline.llm.words import slices

#: Pages of the training grammar.
TRAIN_PAGES = 900
_GROUP = {name: code for code, name in enumerate(GROUP_NAMES)}
_AGAINST = np.isin(np.arange(len(GROUP_NAMES)), [_GROUP[g] for g in ("nav", "aside", "header", "footer", "form")])
_FOR = np.arange(len(GROUP_NAMES)) == _GROUP["article"]


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, from 0."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))


def features(trees: Forest) -> np.ndarray:
    """One row of features per node."""
    n, parent, depth, last = len(trees.parent), trees.parent, trees.depth, trees.last
    up = np.maximum(parent, 0)
    is_root = parent < 0
    prefix = np.concatenate((np.zeros((1, trees.counts.shape[1])), np.cumsum(trees.counts, axis=0)))
    total = {name: x for name, x in zip(COUNTS, (prefix[last] - prefix[:n]).T, strict=True)}
    page = np.repeat(np.arange(len(trees.first) - 1), np.diff(trees.first))
    root = trees.first[:-1][page]
    chars = total["chars"]
    ratio = lambda a, b: a / np.maximum(b, 1)
    link_share = ratio(total["links"], chars)

    # What stands above, level by level.
    against, favour = _AGAINST[trees.group].astype(float), _FOR[trees.group].astype(float)
    above = np.zeros((n, 5))
    above[:, 4] = 20
    for at in _levels(depth)[1:]:
        p = parent[at]
        above[at, 0] = above[p, 0] + against[p]
        above[at, 1] = above[p, 1] + favour[p]
        above[at, 2] = above[p, 2] + trees.other_words[p]
        above[at, 3] = above[p, 3] + trees.content_words[p]
        above[at, 4] = np.where(favour[p] + trees.content_words[p] > 0, 1, above[p, 4] + 1)

    # Siblings: nodes with one parent, in page order.
    order = np.lexsort((np.arange(n), parent + (is_root * -(1 + page))))
    same = np.concatenate(([False], (parent[order][1:] == parent[order][:-1]) & ~is_root[order][1:]))
    begin = np.maximum.accumulate(np.where(~same, np.arange(n), 0)) if n else np.zeros(0, int)
    number = np.empty(n)
    number[order] = np.arange(n) - begin
    siblings = np.bincount(up[~is_root], minlength=n)[up] if n else np.zeros(0)
    before, after = np.zeros(n), np.zeros(n)
    link_before = np.zeros(n)
    if n > 1:
        before[order[1:]] = np.where(same[1:], chars[order[:-1]], 0)
        link_before[order[1:]] = np.where(same[1:], link_share[order[:-1]], 0)
        after[order[:-1]] = np.where(same[1:], chars[order[1:]], 0)
    alike = np.zeros(n)
    if n:
        key = up * len(GROUP_NAMES) + trees.group
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        alike = count[which].astype(float)
    biggest = np.zeros(n)
    np.maximum.at(biggest, up[~is_root], chars[~is_root])

    flags = [(trees.group == _GROUP[g]).astype(float) for g in ("text", "paragraph", "heading", "item", "list", "div", "section", "article", "table", "quote")]
    of_parent = [(trees.group[up] == _GROUP[g]).astype(float) for g in ("paragraph", "heading", "item", "div", "table", "quote", "body")]
    columns = [
        *flags, *of_parent, against, against[up], favour[up], trees.content_words, trees.other_words, trees.content_words[up], trees.other_words[up], *above.T,
        np.log1p(chars), np.log1p(total["words"]), link_share, ratio(total["stops"], total["words"]), ratio(total["commas"], total["words"]), total["controls"], total["copyright"], np.log1p(total["blocks"]),
        ratio(chars, total["blocks"]), ratio(chars, total["tags"]), ratio(total["paragraphs"], total["blocks"]), np.log1p(total["paragraphs"]), ratio(chars, chars[root]), ratio(chars, chars[up]), ratio(biggest, chars),
        depth, ratio(prefix[:n, 0] - prefix[root, 0], chars[root]), number, ratio(number, siblings), siblings, alike, np.log1p(before), np.log1p(after), link_before, link_share[up], ratio(chars[up], chars[root]), np.log1p(chars[up]),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if n else np.zeros((0, len(columns)))


def decode(trees: Forest, odds: np.ndarray) -> np.ndarray:
    """The most likely labels that agree along every path: True where a node holds article text."""
    n, depth, parent = len(odds), trees.depth, trees.parent
    is_text = trees.group == _GROUP["text"]
    gain, below, best = odds.copy(), np.zeros(n), np.full(n, -np.inf)
    chosen = np.zeros(n, bool)
    levels = _levels(depth)
    for at in reversed(levels):
        inner = at[~is_text[at]]
        # A container needs a child: those that gain, or else the one that loses least.
        gain[inner] = odds[inner] + np.where(best[inner] > 0, below[inner], best[inner])
        child = at[parent[at] >= 0]
        np.add.at(below, parent[child], np.maximum(gain[child], 0))
        np.maximum.at(best, parent[child], gain[child])
    alone = np.full(n, -1)
    needy = np.flatnonzero((parent >= 0) & (gain == best[np.maximum(parent, 0)]) & (gain <= 0))[::-1]
    alone[parent[needy]] = needy  # the first of equals
    for at in levels:
        up = np.maximum(parent[at], 0)
        chosen[at] = np.where(parent[at] < 0, gain[at] > 0, chosen[up] & ((gain[at] > 0) | (alone[up] == at)))
    return chosen


def extract_texts(pages: list[str | None], model: boosting.Forest) -> list[str]:
    """The main text of each page."""
    trees = plant([p or "" for p in pages])
    kept = decode(trees, model.margin(features(trees))) & (trees.group == _GROUP["text"])
    out = []
    for a, b in zip(trees.first[:-1].tolist(), trees.first[1:].tolist(), strict=True):
        out.append("\n".join(t for i in np.flatnonzero(kept[a:b]).tolist() if (t := trees.texts[a + i])))
    return out


_trained: dict[int, boosting.Forest] = {}


def train(pages: int = TRAIN_PAGES) -> boosting.Forest:
    """The classifier, trained on so many pages of the grammar."""
    from tideline.llm.html_grammar import MARK, labelled_pages

    if pages not in _trained:
        trees = plant(labelled_pages(pages))
        own = np.array([t is not None and MARK in t for t in trees.texts], float)
        prefix = np.concatenate(([0.0], np.cumsum(own)))
        label = ((prefix[trees.last] - prefix[:-1]) > 0).astype(float)
        marks = np.array([0 if t is None else t.count(MARK) for t in trees.texts], float)
        trees.counts[:, COUNTS.index("chars")] -= marks  # the marks of the labels are no text
        _trained[pages] = boosting.fit(features(trees), label)
    return _trained[pages]


def extract(pages: DataFrame, html: str = "html", model: boosting.Forest | None = None) -> DataFrame:
    """``pages`` without the HTML column, and ``text`` and ``n_chars``."""
    bound_arrow(pages.sparkSession)
    model = model or train()
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html", 2 << 20):
                texts = extract_texts(part.column(len(keep)).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(tidy(run), schema)
