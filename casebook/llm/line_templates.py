r"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

Every line is parsed: fields that vary (words with a digit) become ``<*>``. The tree's first level is the token count, the next ``DEPTH``
levels are the leading tokens, and a leaf holds the different masked lines that come to it with how often they occur.

* In a leaf the commonest line is the centre, and so is the commonest line among those that agree in all even, or in all odd, tokens.
* Similarity step: a line belongs to a centre's template if at least ``SIMILAR`` of its tokens are the centre's; where they differ the
  template has ``<*>``. A line may belong to several templates, and its own masked form is always one.
* A template is recurring if it occurs in at least ``min_docs`` different documents. Documents with the same masked lines
  are copies of each other and count as one.
* The lines of recurring templates are dropped, save in the first document (the smallest id, nulls last) that holds the template, and its copies.
  A document of which recurring lines hold ``COPY_SHARE`` of the characters or more is a near copy and not one with a passage in it; it
  stays whole, for document-level dedup to decide (cut down to its edits it would be found by nothing). A template without a fixed token is none.

Only hashes of lines and tokens are shuffled. Lines of a leaf are counted with map-side partial sums, each line meets only the
centres of its leaf and halves, and the joins are equi-joins that can be split, so a template in a third of all documents is no hot group.

Defined cases: a null text has no lines and stays null; an empty text stays empty; blank lines are never dropped. Rows equal
in id and text are one document and get the same result; other texts under an id, or under none, are documents of their own.
Ties go to the line with the larger hash. Very long texts and lines are parsed whole. An empty table gives no rows. `drop_recurring` reads the id and
text alone and `clean` carries the other columns in a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import documents, written

DEPTH = 3
MIN_DOCS = 5
MIN_TOKENS = 1
SIMILAR = 0.75
COPY_SHARE = 0.75
FIELD = "<*>"
#: A token with a digit; the possessive runs keep it linear on long texts without blanks.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def masked(text: Column) -> Column:
    """The text with its variable fields generalised; line ends stay."""
    return F.regexp_replace(text, VARIABLE, FIELD)


def path(line: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """struct<leaf, exact, tokens> of a masked line: its leaf, its own hash, and the hashes of its tokens; null for a line that is no template."""

    def of(t: Column) -> Column:
        fixed = (F.size(t) >= F.lit(min_tokens)) & F.exists(t, lambda x: x != FIELD)
        leaf = F.xxhash64(F.size(t), F.slice(t, 1, DEPTH))
        return F.when(fixed, F.struct(leaf.alias("leaf"), F.xxhash64(t).alias("exact"), F.transform(t, lambda x: F.hash(x)).alias("tokens")))

    return F.transform(F.array(F.array_remove(F.split(line, r"\s+"), "")), of)[0]


def parsed(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, _text_hash, copy (the same for documents of the same masked lines), lines (`path` of each) of every row with a text."""
    lines = F.split(masked(F.col("text")), "\n", -1)
    trees = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_text_hash"), F.transform(lines, lambda x: path(x, min_tokens)).alias("lines"))
    return trees.select("*", F.xxhash64(F.transform("lines", lambda x: x["exact"])).alias("copy"))


def centred(lines: DataFrame, min_docs: int = MIN_DOCS, similar: float = SIMILAR) -> DataFrame:
    """exact, template: the other lines' templates that a line belongs to; ``lines``: leaf, exact, tokens of every line."""
    # a leaf with one line only, or with fewer lines than documents are asked for, has nothing to generalise
    leaves = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("exact").alias("low"), F.max("exact").alias("high"))
    mixed = written(leaves.where((F.col("n") >= min_docs) & (F.col("low") != F.col("high"))).select("leaf"))
    held = written(lines.join(mixed, "leaf", "left_semi").groupBy("leaf", "exact").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")))
    half = lambda k: F.xxhash64("leaf", F.lit(k), F.filter("tokens", lambda _, i: i % 2 == k))
    keyed = held.select("exact", "tokens", "n", F.explode(F.array("leaf", half(0), half(1))).alias("key"))
    centres = keyed.groupBy("key").agg(F.max(F.struct("n", "exact", "tokens")).alias("centre"))
    met = keyed.join(centres, "key").where(F.col("exact") != F.col("centre.exact"))
    same = F.aggregate(F.zip_with("tokens", "centre.tokens", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return met.where(same >= similar * F.size("tokens")).select("exact", F.col("centre.exact").alias("template")).distinct()


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """template, n_docs, keeper (the copies that keep it) of the templates in at least ``min_docs`` documents; ``lines``: template, doc_id, copy."""
    holders = lines.groupBy("template", "copy").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first"))
    templates = holders.groupBy("template").agg(F.count("*").alias("n_docs"), F.min(F.struct("first", "copy"))["copy"].alias("keeper"))
    return templates.where(F.col("n_docs") >= min_docs)


def drop_recurring(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR, copy_share: float = COPY_SHARE
) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_recurring (those of recurring templates that it need not keep) and n_dropped lines (long), of every row."""
    return _dropped(documents(df, id_col, text_col), min_docs, min_tokens, similar, copy_share).drop("_more")


def clean(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similar: float = SIMILAR, copy_share: float = COPY_SHARE
) -> DataFrame:
    """All rows and columns of ``df`` with the recurring lines dropped from ``text_col``."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *(c for c in df.columns if c != text_col)).alias("_more"))
    left = _dropped(docs, min_docs, min_tokens, similar, copy_share)
    return left.select(*(F.col("text").alias(c) if c == text_col else F.col(f"_more.`{c}`").alias(c) for c in df.columns))


def _dropped(docs: DataFrame, min_docs: int, min_tokens: int, similar: float, copy_share: float) -> DataFrame:
    docs = docs if "_more" in docs.columns else docs.withColumn("_more", F.lit(None))
    trees = written(parsed(docs, min_tokens))
    lines = trees.select("doc_id", "_text_hash", "copy", F.posexplode("lines").alias("line", "at")).where("at is not null")
    own = lines.select("doc_id", "_text_hash", "copy", "line", F.col("at.exact").alias("exact"))
    members = written(centred(lines.select("at.*"), min_docs, similar))
    of = own.withColumnRenamed("exact", "template").unionByName(own.join(members, "exact").drop("exact"))
    found = recurring(of, min_docs).select("template", "keeper")
    hits = (
        of.join(found, "template").where(F.col("copy") != F.col("keeper"))
        .groupBy("doc_id", "_text_hash").agg(F.collect_set("line").alias("_hit"))
        .withColumnsRenamed({"doc_id": "_id", "_text_hash": "_hash"})
    )
    hashed = docs.withColumn("_text_hash", F.xxhash64("text"))
    met = hashed.join(hits, hashed["doc_id"].eqNullSafe(hits["_id"]) & (hashed["_text_hash"] == hits["_hash"]), "left")

    def cut(parts: Column) -> Column:
        """What stays of a text's lines, and whether the rest is not all; the hashed set difference is linear in the lines."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_hit"))
        gone = F.aggregate(F.transform("_hit", lambda k: F.length(F.get(parts, k))), F.lit(0).cast("long"), lambda n, x: n + x)
        whole = F.length("text") - F.size(parts) + 1
        return F.struct(F.array_join(F.transform(stay, lambda k: F.get(parts, k)), "\n").alias("text"), (gone < copy_share * whole).alias("drop"))

    cuts = F.when(F.col("_hit").isNotNull(), F.transform(F.array(F.split("text", "\n", -1)), cut)[0])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)
    n_hit = F.coalesce(F.size("_hit"), F.lit(0)).cast("long")
    measured = met.select("doc_id", "_more", "text", n_lines.cast("long").alias("n_lines"), F.when(F.col("_hit").isNull(), 0).otherwise(n_hit).cast("long").alias("n_recurring"), cuts.alias("_cut"))
    drop = F.coalesce("_cut.drop", F.lit(False))
    return measured.select(
        "doc_id", "_more", F.when(drop, F.col("_cut.text")).otherwise(F.col("text")).alias("text"), "n_lines", "n_recurring",
        F.when(drop, F.col("n_recurring")).otherwise(0).cast("long").alias("n_dropped"),
    )
