"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest matching rule wins."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: A trie is broadcast only up to so many rules (about 100 MB); more are joined as a table.
MAX_BROADCAST_RULES = 200_000


class Trie:
    """Nodes are dicts: a host label or, below "/", a path segment leads on. A rule whose path ends inside a segment
    hangs at its parent under None as (rest, rule)."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(label, {})
            *whole, rest = rule.path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            found = node.setdefault(None, {})
            if rule.verdict == "allow" or rest not in found:  # of a rule that is in both lists, allow holds
                found[rest] = rule

    def match(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if "/" in node:
                best = self._path(node["/"], segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for segment in segments:
            for rest, rule in sorted(node.get(None, {}).items(), key=lambda x: len(x[0])):
                if segment.startswith(rest):
                    best = rule
            node = node.get(segment)
            if node is None:
                break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the empty string where there is no ``://``; only A-Z are lower-cased."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*(/[^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Rule] = RULES, default: str = "allow"
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all its subdomains where the path starts with its own; the longest host, then the longest
    path wins, and where none fits ``default`` holds. A null url, or one without ``://``, has empty host and path, which
    no rule fits. Repeated rows are judged each. Other columns are not read.
    """
    rules = list(rules)
    host, path = host_and_path(col(url_col))
    urls = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if len(rules) > MAX_BROADCAST_RULES:
        return _joined(urls, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        found = [match(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame(
            {
                "rule": [r and r.host + r.path for r in found],
                "verdict": [r.verdict if r else default for r in found],
            },
            dtype=object,
        )

    return urls.withColumn("j", judge("host", "path")).select("page_id", "host", "path", "j.rule", "j.verdict")


def _joined(urls: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same for rule lists that are too large to broadcast: every suffix of the host meets the rules of that host."""
    spark = urls.sparkSession
    table = spark.createDataFrame(rules, "verdict string, suffix string, start string")
    urls = urls.withColumn("uid", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    found = (
        urls.select("page_id", "host", "path", labels.alias("labels")).select("host", "path", F.explode(suffixes).alias("suffix"))
        .distinct().join(table, "suffix").where("startswith(path, start)")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.size(F.split("suffix", r"\.")).alias("labels"), F.length("start").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.concat("suffix", "start").alias("rule"), "verdict")).alias("m"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict")
    )
