"""URL filters: rules found by their rarest literal token.

A rule is a regular expression on a URL with the literal tokens that every
match must hold. Of these the one that fewest URLs of the table hold is its
index key. A URL's own tokens fetch the rules filed under them, and only those
run their regular expression; the winner is the rule of the greatest rank, then
the longest, then a block rule before an allow rule. Rules without a literal
token are filed under the empty token, which every URL has.

The rules are a table, of any size. Distinct URLs give their tokens, tokens
join the index (broadcast up to ``BROADCAST_BYTES`` bytes, else by shuffle, where
a very common token is split among tasks), and each URL's best match joins the
rows. Everything is DataFrame code.

Cases: a null URL, or one without ``://``, has empty host and path and matches
no host rule; very long URLs are matched whole; repeated rows and rules get
equal results; ties between rules go to the greater name; an empty table gives
an empty result; other columns pass through unless their name is one of the
results'.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.store import materialize

#: Bytes of rules, or of matched URLs, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
RESULT_NAMES = ["host", "path", "rule", "verdict"]
RULE_COLUMNS = "name: string, pattern: string, verdict: string, tokens: array<string>, `where`: string, `rank`: int"
_TOKEN = r"[^a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against ``host`` + ``path`` (``where='site'``) or the whole URL with A-Z lower-cased (``where='url'``)."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    where: str = "url"
    #: Rules of a greater class win over others, whatever their length.
    rank: int = 0


def _quoted(text: str) -> str:
    """The text as a literal of Java's regular expressions."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def _whole_tokens(text: str, open_start: bool = False, open_end: bool = False) -> tuple[str, ...]:
    """The tokens that any text holding ``text`` has; one at an open end may be a part of a longer one."""
    found = list(re.finditer("[a-z0-9]+", text))
    return tuple(dict.fromkeys(m[0] for m in found if not (open_start and m.start() == 0) and not (open_end and m.end() == len(text))))


def site_rule(site: str, verdict: str) -> UrlRule:
    """A rule like ``example.net/en/``: the host and its subdomains, and paths that begin so."""
    host, slash, path = site.partition("/")
    tokens = dict.fromkeys((*_whole_tokens(host.lower()), *(_whole_tokens((slash + path).lower(), open_end=True) if path else ())))
    return UrlRule(site, rf"^(?:[^/]*\.)?{_quoted(host.lower() + slash + path)}", verdict, tuple(tokens), "site", 1)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A rule for a word of the host name, alone or joined by hyphens."""
    return UrlRule(word, rf"^[^/?#]*://[^/?#]*(?<![a-z0-9]){_quoted(word.lower())}(?![a-z0-9])[^/?#]*", verdict, _whole_tokens(word.lower()))


def filter_rule(line: str) -> UrlRule | None:
    """A rule in the syntax of public filter lists: ``||host^``, ``|start``, ``end|``, ``*``, ``^`` (a separator), ``@@`` (allow).

    Comments, options and rules for page elements give none.
    """
    name = line.strip()
    body, verdict = (name[2:], "allow") if name.startswith("@@") else (name, "block")
    if not body or body[0] in "![" or "##" in body or "#@#" in body or "$" in body:
        return None
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|") and len(body) > 2
    body = body[2 if host else 1 if start else 0 : -1 if end else None].lower()
    pattern = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else _quoted(c) for c in body)
    pattern = (r"^[^/?#]*://(?:[^/?#]*\.)?" if host else "^" if start else "") + pattern + ("$" if end else "")
    parts = body.split("*")
    tokens = [t for i, p in enumerate(parts) for t in _whole_tokens(p, open_start=i > 0 or not (host or start), open_end=i < len(parts) - 1 or not end)]
    return UrlRule(name, pattern, verdict, tuple(dict.fromkeys(tokens)), "url", 1 if verdict == "allow" else 0)


# Words of hosts that sell, track or spam.
SPAM_WORDS = ["spam", "spam-farm", "casino", "casino-win", "pills", "cheap-pills", "free-bets", "bets", "ads", "ads-track", "adserver", "doubleclick", "viagra", "poker", "porn", "xxx", "payday-loan", "replica-watches", "clickbait", "popunder"]


def default_rules() -> list[UrlRule]:
    return [word_rule(w) for w in SPAM_WORDS]


def rule_table(spark: SparkSession, rules: Iterable[UrlRule]) -> DataFrame:
    """The rules as a table, read from one JSON text by the engine."""
    text = json.dumps([asdict(r) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{RULE_COLUMNS}>>")))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    """The distinct tokens of a text, and the empty one."""
    return F.array_distinct(F.concat(F.split(F.translate(text, _UPPER, _LOWER), _TOKEN), F.array(F.lit(""))))


def index_of(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rules`` with ``token``, the one of their tokens that fewest rows of ``tokens`` (``token``) hold."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    each = rules.select("name", "pattern", "verdict", "where", "rank", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    rarest = F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token")).alias("rarest")
    return each.join(held, "token", "left").groupBy("name", "pattern", "verdict", "where", "rank").agg(rarest).select("*", F.col("rarest.token").alias("token")).drop("rarest")


def _small(rows: DataFrame, *texts: str) -> DataFrame:
    """A table for the small side of a join: broadcast if its texts, and some bytes a row, are within the bound."""
    size = rows.agg(F.sum(sum((F.octet_length(t) for t in texts), F.lit(100)))).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and ``won`` (its best rule) of the distinct URLs that any rule matches."""
    urls = urls.where("url is not null").distinct()
    tokens = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    index = materialize(index_of(rules, tokens), "url-rules")
    fetched = tokens.join(_small(index, "name", "pattern", "token"), "token")
    text = F.when(F.col("where") == "site", F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(F.translate("url", _UPPER, _LOWER))
    matched = fetched.where(F.call_function("rlike", text, F.col("pattern")))
    order = F.struct("rank", F.char_length("name").alias("length"), (F.col("verdict") == "block").alias("block"), "name", "verdict", "where")
    return matched.groupBy("url").agg(F.max(order).alias("won"))


def filter_urls(pages: DataFrame, site_rules: DataFrame | list[UrlRule], rules: DataFrame | list[UrlRule] | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the site rule that won (or null) and a verdict.

    Rules are lists or tables with ``RULE_COLUMNS``. Site rules win over the
    other rules, whose names are not reported.
    """
    spark = pages.sparkSession
    both = [r if isinstance(r, DataFrame) else rule_table(spark, r) for r in (site_rules, default_rules() if rules is None else rules)]
    won = materialize(best_rules(pages.select(F.col(f"`{url}`").alias("url")), both[0].unionByName(both[1])), "url-verdicts")
    own = [(i, c) for i, c in enumerate(pages.columns) if c.lower() not in RESULT_NAMES]
    rows = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in own], F.col(f"`{url}`").alias("url")).join(_small(won, "url", "won.name"), "url", "left")
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in own],
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("won.where") == "site", F.col("won.name")).alias("rule"),
        F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"),
    )
