r"""Quality rules: base statistics of each text, and cross-document line frequency.

Lines are normalised (lower case, digits as 0, runs of blanks as one) and hashed; for
each host the distinct documents that hold a line are counted. Lines in more than
``max_docs`` documents of a host are boilerplate and removed, however large or small the host is; a document
of which less than ``min_left`` of the characters remain is depleted and rejected. What remains of each text is the column ``left``.
Hosts are the values of ``host_col`` (a null host is a host of its own).

The counts are sums with map-side partials, so neither a hot host nor a hot line is a
hot group; the join of lines with the removed ones is an equi-join that can be split.

Defined cases: a null or empty text has all statistics 0 and fails the base rules; ``left`` of a null text is null.
Rows equal in id and text count as one document and get equal results; other texts under one id, or under none, are
documents of their own. Very long texts are counted whole. An empty table gives no rows. Only the id, text and host columns are
read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import documents

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_DOCS, MIN_LEFT = 3, 0.5
BLANKS = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at ASCII white space only
    n_chars = len(text) - sum(map(raw.count, (bytes([b]) for b in BLANKS)))
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), 0  # covered: the first word not yet counted
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated += k + 3 - max(k, covered)
                covered = k + 3
    return len(words), n_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")])


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"\s+", " "))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, position, line hash and characters of every line that is not blank."""
    lines = docs.where("text is not null").select("doc_id", "host", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("position", "raw"))
    lines = lines.select("doc_id", "host", "text_hash", "position", normalised(F.col("raw")).alias("plain"), F.length("raw").alias("chars"))
    return lines.where("plain <> ''").select("doc_id", "host", "text_hash", "position", F.xxhash64("plain").alias("line"), "chars")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, line, n_docs of the lines above the limit; ``docs``: doc_id, text, host, text_hash."""
    held = _lines(docs).select("host", "line", "doc_id", "text_hash").distinct()
    return held.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the statistics, n_frequent_lines and n_frequent_chars (removed), left (the other lines), base_failed and kept of every row."""
    docs = documents(df, id_col, text_col, host_col).withColumnRenamed(host_col, "host").withColumn("text_hash", F.xxhash64("text"))
    frequent = frequent_lines(docs, max_docs).withColumnsRenamed({"host": "_host", "line": "_line"})
    lines = _lines(docs)
    removed = (
        lines.join(frequent, lines["host"].eqNullSafe(frequent["_host"]) & (lines["line"] == frequent["_line"]), "left_semi")
        .groupBy("doc_id", "host", "text_hash").agg(F.collect_set(F.struct("position", "chars")).alias("_lines"))
        .select(
            F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_text"), F.size("_lines").cast("long").alias("_n"),
            F.aggregate("_lines", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("_chars"), F.transform("_lines", lambda x: x["position"]).alias("_gone"),
        )
    )
    own = docs.select("doc_id", "host", "text", "text_hash", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.pandas_udf(_stats, STATS)("text").alias("s"))
    same = own["doc_id"].eqNullSafe(removed["_id"]) & own["host"].eqNullSafe(removed["_host"]) & (own["text_hash"] == removed["_text"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # the hashed set difference of positions is linear in their number and keeps their order
    parts = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    left = F.transform(F.array(parts), lambda x: F.array_join(F.transform(stay, lambda k: F.get(x, k)), "\n"))[0]
    judged = own.join(removed, same, "left").select(
        "doc_id", "s.*", "n_chars", F.coalesce("_n", F.lit(0)).cast("long").alias("n_frequent_lines"), F.coalesce("_chars", F.lit(0)).cast("long").alias("n_frequent_chars"),
        F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("left"),
    )
    depleted = F.col("n_chars") - F.col("n_frequent_chars") < min_left * F.col("n_chars")
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("n_chars")
