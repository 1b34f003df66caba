"""URL filters: a trie over reversed host labels, then path segments.

The rules are broadcast as one trie of ``MAX_RULES`` of them at most; of more rules,
one trie after the other is broadcast and judged with, and the longest match of all
decides. A url's host labels are walked from the last one on, so a rule fits its host
and all its subdomains; under each host node a second walk follows the path's segments.
A rule's path fits every path that starts with it, so its last segment may be the start
of a longer one: a node knows the lengths of the segments that end rules, and only
these are tried. Of the fitting rules the one with the longest host, then path,
decides; a url that no rule fits gets ``default``.

Null urls and urls without ``://`` have an empty host and path. An exact rule that
is given twice keeps its allow entry. Rows that repeat a url are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

MAX_RULES = 1_000_000

#: verdict, host, path
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


class RuleTrie:
    def __init__(self, rules) -> None:
        self.root: dict = {}
        for verdict, host, path in sorted(rules):
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks; got {verdict}")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            node = node.setdefault("/", {})
            *full, last = path.split("/")
            for segment in full:
                node = node.setdefault("/" + segment, {})
            # the last segment is a prefix; '' fits all
            node.setdefault("ends", {}).setdefault(last, (f"{host}{path}", verdict, len(host), len(path)))
            node.setdefault("lengths", set()).add(len(last))

    @staticmethod
    def _by_path(node: dict, path: str):
        best = None
        for segment in path.split("/"):
            if "ends" in node:
                for n in sorted(node["lengths"], reverse=True):
                    if n <= len(segment) and (found := node["ends"].get(segment[:n])):
                        best = found
                        break
            node = node.get("/" + segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str):
        """(rule, verdict, its host's and its path's length) of the longest fitting
        rule, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            if "/" in node and (found := self._by_path(node["/"], path)):
                best = found
        return best


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _longest(found: DataFrame, rules: list) -> Column:
    """struct(host length, path length, rule, verdict) by one trie; null: none fits."""
    shared = found.sparkSession.sparkContext.broadcast(RuleTrie(rules))  # MAX_RULES at most

    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in batches:
            rows = [trie.match(h, p) or (None, None, None, None) for h, p in zip(hosts, paths)]
            out = pd.DataFrame(rows, columns=["rule", "verdict", "host", "path"], dtype=object)
            yield out[["host", "path", "rule", "verdict"]].astype({"host": "Int64", "path": "Int64"})

    return F.pandas_udf(verdicts, "host long, path long, rule string, verdict string")("host", "path")


def judge(pages: DataFrame, rules=RULES, url_col="url", default="allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``.

    Columns of these four names are replaced; all others pass through.
    """
    rules = sorted(rules, key=lambda r: (r[1], r[2], r[0]))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    for a in range(0, len(rules) or 1, MAX_RULES):
        more = _longest(found, rules[a : a + MAX_RULES])
        if not a:
            found = found.withColumn("__m", more)
            continue
        # nulls are smallest, and the longer host, then path, is the greater struct
        found = cut(found).withColumn("__n", more).withColumn("__m", F.greatest("__m", "__n")).drop("__n")
    return found.select(*kept, "host", "path", "__m.rule", F.coalesce("__m.verdict", F.lit(default)).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("url")


ORACLE = {
    "op9_url_filters": r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, verdict, rhost, rpath) AS (VALUES
  ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (
  SELECT u.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
}
