"""URL filters: host and path rules, then pattern rules indexed by their rarest literal token.

Two kinds of rules judge a URL, both as expressions of the scan, without a shuffle:

* **Site rules** ``(host, path, verdict)``: a rule fits the URL's host and every subdomain of it
  when the URL's path starts with the rule's path; among fitting rules the longest ``host + path``
  wins (equal lengths: the larger rule string). They are found by looking up each dot-suffix of the host in a map.
* **Pattern rules** ``(verdict, pattern)`` in the filter-list syntax: ``*`` any text, ``^`` a
  separator or the end, ``||`` the start of a host or subdomain, ``|`` at an end anchors it.
  Each rule is indexed by one literal token that every URL it matches must contain as a whole
  token (a maximal run of ``[a-z0-9]``): the one that the fewest URLs of the input contain. A URL
  looks its own tokens up in the index, and only the rules it fetches (with the few that have no
  whole token) run their regular expressions. An ``allow`` rule beats a ``block`` rule; no
  match allows.

The site rules decide where one fits; the pattern rules decide the rest.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is judged by the
patterns on the empty string; repeated pages are judged alike, each row once; extra columns of
the input are not carried (results are keyed by ``page_id``); an empty table gives no rows.
Very long URLs are judged whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["PATTERN_RULES", "SITE_RULES", "judged", "pattern_regex", "whole_tokens"]

# The site rules of the contract as (host, path, verdict), in this order.
SITE_RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: The default pattern rules: spam, pill and adult hosts, ad servers and feed trackers are blocked,
#: the pages of a help site are let through.
PATTERN_RULES: tuple[tuple[str, str], ...] = (
    ("block", "||spam-farm.*"),
    ("block", "||cheap-pills^"),
    ("block", "adult-x."),
    ("block", "/ads/*"),
    ("block", "^banner^"),
    ("block", "*utm_source=feed"),
    ("block", "|http://*/go.php?*"),
    ("allow", "||help.*/faq^"),
    ("block", "*.exe|"),
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path up to ``?`` or ``#``; else both empty."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _UPPER.lower()), F.coalesce(path, F.lit(""))


def pattern_regex(pattern: str) -> str:
    """The regular expression of a filter-list pattern, for lower-cased URLs."""
    text, head, tail = pattern.lower(), "", ""
    if text.startswith("||"):
        text, head = text[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif text.startswith("|"):
        text, head = text[1:], "^"
    if text.endswith("|"):
        text, tail = text[:-1], "$"
    body = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c) for c in text)
    return f"(?s){head}{body}{tail}"


def whole_tokens(pattern: str) -> list[str]:
    """Literal tokens of a pattern that any matching URL holds as whole ``[a-z0-9]+`` runs.

    A run counts when both its neighbours in the pattern are literal non-token characters, a
    ``^`` or an anchor; next to ``*`` or an open end it may be part of a longer token.
    """
    text = pattern.lower()
    start = 2 if text.startswith("||") else 1 if text.startswith("|") else 0
    anchored_end = text.endswith("|")
    body = text[start : len(text) - 1 if anchored_end else len(text)]
    found = []
    for match in _TOKEN.finditer(body):
        before = body[match.start() - 1] if match.start() else ("|" if start else "*")
        after = body[match.end()] if match.end() < len(body) else ("|" if anchored_end else "*")
        if before != "*" and after != "*":
            found.append(match.group())
    return found


def _site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting site rule as struct(rule, verdict), or null."""
    index: dict[str, list[tuple[int, str, str, str]]] = {}
    for rule_host, rule_path, verdict in rules:
        name = f"{rule_host}{rule_path}"
        index.setdefault(rule_host.lower(), []).append((len(name), rule_path, name, verdict))
    entry = "struct<size:int,path:string,rule:string,verdict:string>"
    table = F.create_map(
        *[
            part
            for key, entries in sorted(index.items())
            for part in (
                F.lit(key),
                F.array(*[F.struct(F.lit(s).alias("size"), F.lit(p).alias("path"), F.lit(r).alias("rule"),
                                   F.lit(v).alias("verdict")) for s, p, r, v in entries]),
            )
        ]
    ) if index else F.lit(None).cast(f"map<string,array<{entry}>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = F.filter(
        F.flatten(F.transform(suffixes, lambda s: F.coalesce(table[s], F.array().cast(f"array<{entry}>")))),
        lambda r: F.startswith(path, r["path"]),
    )
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("s"), r["rule"].alias("k"), r.alias("v"))))
    return F.when(F.size(fitting) > 0, best["v"])


def rarest_tokens(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> list[str | None]:
    """For each rule its whole token that the fewest URLs contain (ties: longer, then smaller).

    The counts are taken over every URL by Spark; only the counts of the rules' own tokens, a
    list no longer than the rules, come to the driver.
    """
    wanted = sorted({t for _, p in rules for t in whole_tokens(p)})
    counts: dict[str, int] = {}
    if wanted:
        tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit("[a-z0-9]+"), 0))
        found = (
            urls.select(F.explode(F.filter(tokens, lambda t: t.isin(wanted))).alias("token"))
            .groupBy("token").count()
        )
        counts = {row["token"]: row["count"] for row in found.collect()}
    chosen = []
    for _, pattern in rules:
        tokens = whole_tokens(pattern)
        chosen.append(min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else None)
    return chosen


def judged(
    pages: DataFrame,
    site_rules: Sequence[tuple[str, str, str]] = SITE_RULES,
    pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES,
) -> DataFrame:
    """page_id, host, path, rule (fitting site rule or null), verdict, pattern (deciding pattern or null)."""
    keys = rarest_tokens(pages, pattern_rules)
    regexes = [pattern_regex(p) for _, p in pattern_rules]
    index: dict[str, list[int]] = {}
    for number, key in enumerate(keys):
        if key is not None:
            index.setdefault(key, []).append(number)
    always = [n for n, key in enumerate(keys) if key is None]
    lookup = (
        F.create_map(*[x for k, ids in sorted(index.items()) for x in (F.lit(k), F.array(*map(F.lit, ids)))])
        if index else F.lit(None).cast("map<string,array<int>>")
    )
    patterns = F.array(*map(F.lit, regexes)) if regexes else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _ in pattern_rules]) if regexes else F.array().cast("array<string>")
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    tokens = F.array_distinct(F.regexp_extract_all(F.col("__url"), F.lit("[a-z0-9]+"), 0))
    fetched = F.array_distinct(F.concat(
        F.flatten(F.transform(tokens, lambda t: F.coalesce(lookup[t], F.array().cast("array<int>")))),
        F.array(*map(F.lit, always)).cast("array<int>"),
    ))
    matched = F.array_sort(F.filter(fetched, lambda r: F.regexp_like(F.col("__url"), F.get(patterns, r))))
    allowed = F.filter(matched, lambda r: F.get(verdicts, r) == "allow")
    deciding = F.coalesce(F.get(allowed, F.lit(0)), F.get(matched, F.lit(0)))
    host, path = host_and_path(F.col("url"))
    site = _site_rule(F.col("host"), F.col("path"), site_rules)
    return (
        pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), url.alias("__url"))
        .withColumn("__site", site)
        .withColumn("__deciding", deciding)
        .select(
            "page_id", "host", "path",
            F.col("__site.rule").alias("rule"),
            F.coalesce(F.col("__site.verdict"), F.get(verdicts, F.col("__deciding")), F.lit("allow")).alias("verdict"),
            F.when(F.col("__site").isNull(), F.get(
                F.array(*[F.lit(p) for _, p in pattern_rules]).cast("array<string>"), F.col("__deciding")
            )).alias("pattern"),
        )
    )
