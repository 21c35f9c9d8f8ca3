"""Full-text search: all tokens must occur; newest first, paged by offset; the total counts all matches.

`found`, `total` and `page` go through the events. The ``indexed_`` forms answer from a stored inverted index: posting lists by lexeme, in blocks of a time slot, in a table that is
bucketed by lexeme. A query reads its tokens' buckets, intersects block by block, and fetches only the events it shows.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.errors import ValidationError
from casebook.functions.text import search_text
from casebook.operators.timeline import event_lexemes, in_window, matches, picked
from casebook.schema import SEARCH_BYTES, SEARCH_LIMIT, SEARCH_MAX, SEARCH_OFFSET_MAX
from casebook.sources.stored import StoredTable

SLOT_SECONDS = 3600
BLOCK = 65_536  # events of a block


def found(df: DataFrame, query: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    query = search_text(query, SEARCH_BYTES)
    if not query:
        raise ValidationError("the search query is empty")
    return in_window(df, start, end).where(matches(df, query))


def total(df: DataFrame, query: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    return found(df, query, start, end).agg(F.count("*").alias("total"))


def _checked(limit: int, offset: int) -> int:
    if not 0 <= offset <= SEARCH_OFFSET_MAX:
        raise ValidationError(f"offset must be between 0 and {SEARCH_OFFSET_MAX}")
    return min(limit or SEARCH_LIMIT, SEARCH_MAX)


def page(df: DataFrame, query: str, limit: int = 0, offset: int = 0, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Limit 0 is the default; above the maximum it is the maximum."""
    limit = _checked(limit, offset)
    return found(df, query, start, end).orderBy(F.desc("occurred_at"), F.desc("event_id")).offset(offset).limit(limit)


# ---- the stored index ----------------------------------------------------------------------------


def inverted_index(df: DataFrame) -> DataFrame:
    """(lexeme, event_id, occurred_at) rows."""
    return df.select("event_id", "occurred_at", F.explode(event_lexemes(df)).alias("lexeme"))


def _slot(at: Column | str) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp") if isinstance(at, str) else at.cast("timestamp")) / (SLOT_SECONDS * 1_000_000)).cast("long")


def posting_lists(df: DataFrame) -> DataFrame:
    """lexeme, slot, parts, part, n, ids: the events of a time slot that hold a lexeme, in blocks.

    A slot with more than about ``BLOCK`` events is dealt to parts by a hash of the event, to the same parts for all lexemes, so blocks with equal (slot, parts, part)
    can be intersected. A block is never longer than its part has events, however common the lexeme is.
    """
    most = df.groupBy(_slot("occurred_at").alias("slot")).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // BLOCK) or 1
    rows = inverted_index(df).where("lexeme <> ''").withColumns({"slot": _slot("occurred_at"), "parts": F.lit(parts), "part": F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")})
    posted = F.sort_array(F.collect_list(F.struct(F.col("occurred_at").alias("at"), F.col("event_id").alias("id"))))
    return rows.groupBy("lexeme", "slot", "parts", "part").agg(F.count("*").alias("n"), posted.alias("ids"))


def wanted(query: str) -> list[str]:
    """The different tokens of a query, sorted."""
    query = search_text(query, SEARCH_BYTES)
    if not query:
        raise ValidationError("the search query is empty")
    return sorted(set(query.lower().split()))


def _met(postings: StoredTable, spark: SparkSession, query: str, start: datetime | None, end: datetime | None) -> DataFrame:
    """Blocks of the events that hold all tokens: ids."""
    tokens = wanted(query)
    rows = postings.of(spark, tokens)
    for at, test in ((start, Column.__ge__), (end, Column.__le__)):
        if at is not None:
            rows = rows.where(test(F.col("slot"), _slot(F.lit(at))))
    if len(tokens) == 1:
        return rows.select("ids")
    # at most one block a token and batch
    met = rows.groupBy("slot", "parts", "part").agg(F.collect_list(F.struct("lexeme", "ids")).alias("lists"), F.count_distinct("lexeme").alias("n_tokens")).where(F.col("n_tokens") == len(tokens))
    of = lambda token: F.flatten(F.transform(F.filter("lists", lambda x: x["lexeme"] == token), lambda x: x["ids"]))
    return met.select(reduce(F.array_intersect, map(of, tokens)).alias("ids"))


def indexed_hits(postings: StoredTable, spark: SparkSession, query: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """event_id, occurred_at of the events that hold all tokens, from the tokens' buckets alone."""
    rows = _met(postings, spark, query, start, end).select(F.explode("ids").alias("x")).select(F.col("x.id").alias("event_id"), F.col("x.at").alias("occurred_at"))
    return in_window(rows, start, end)


def indexed_total(postings: StoredTable, spark: SparkSession, query: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    if start is not None or end is not None:
        return indexed_hits(postings, spark, query, start, end).agg(F.count("*").alias("total"))
    tokens = wanted(query)
    sizes = postings.of(spark, tokens).select("n") if len(tokens) == 1 else _met(postings, spark, query, None, None).select(F.size("ids").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


def indexed_page(postings: StoredTable, events: DataFrame, query: str, limit: int = 0, offset: int = 0, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """`page` from the index; of the events only the page's rows are read."""
    limit = _checked(limit, offset)
    hits = indexed_hits(postings, events.sparkSession, query, start, end).orderBy(F.desc("occurred_at"), F.desc("event_id")).offset(offset).limit(limit)
    return picked(events, hits).orderBy(F.desc("occurred_at"), F.desc("event_id"))
