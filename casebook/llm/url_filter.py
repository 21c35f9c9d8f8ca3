"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains whose path
starts with the rule's path; the longest fitting rule wins, whatever its verdict.
The trie is walked once for each URL, label by label and then segment by segment,
so its cost follows the URL's depth and not the number of rules.

The rules are broadcast only while they are at most ``MAX_BROADCAST_RULES``; longer
lists are joined by host instead (`_joined`), with the same results.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no
rule and the default verdict. Very long URLs are walked whole. Repeated rows are judged each by itself; an empty table gives no rows. Only the
id and URL columns are read, so other columns' names cannot clash. If the same
(host, path) is listed twice with two verdicts, ``allow`` holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import ascii_lower

MAX_BROADCAST_RULES = 200_000
END = ""  # no label or segment of a rule is empty below the root, so this key can mark a rule's end


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Sequence[Rule]) -> dict:
    """host label -> ... -> {END: {path segment -> ... -> {END: {length of rest -> {rest: (rule name, verdict)}}}}}."""
    trie: dict = {}
    for rule in sorted(set(rules), key=lambda r: r.verdict == "allow"):
        node = trie
        for label in reversed(rule.host.split(".")):
            node = node.setdefault("." + label, {})
        node = node.setdefault(END, {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault("/" + segment, {})
        node.setdefault(END, {}).setdefault(len(rest), {})[rest] = (rule.name, rule.verdict)
    return trie


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest fitting rule's name and verdict; of two of one length, that of the longer host."""
    best: tuple[int, str | None, str | None] = (-1, None, None)
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get("." + label)
        if node is None:
            break
        at = node.get(END)
        for k in range(len(segments)):
            if at is None:
                break
            for n, rests in at.get(END, {}).items():  # one look a length, however many rules end here
                name, verdict = rests.get(segments[k][:n], (None, None))
                if name is not None and len(name) >= best[0]:
                    best = (len(name), name, verdict)
            at = at.get("/" + segments[k])
    return best[1:]


def _walked(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield pd.DataFrame([longest(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    return pages.withColumn("_found", found("host", "path")).select("page_id", "host", "path", "_found.rule", "_found.verdict")


def _joined(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """For rule lists too long to broadcast: each host meets the rules of its suffixes by an equi-join."""
    spark = pages.sparkSession
    listed = (
        spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, verdict string")
        .groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    )
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        urls.withColumn("rule_host", F.explode(suffixes)).join(listed, "rule_host").where(F.expr("startswith(path, rule_path)"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best"))
    )
    return pages.join(best, ["host", "path"], "left").select("page_id", "host", "path", "best.rule", "best.verdict")


def judge(
    df: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES
) -> DataFrame:
    """page_id, host, path, the winning rule (else null) and the verdict (else ``default``) of every row."""
    pages = df.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    found = (_walked if len(rules) <= max_broadcast else _joined)(pages, rules)
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
