"""A corpus pipeline of five stages, each one of the operators in ``casebook.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder
and reads them again as the next stage's documents.

Defined cases: null texts go in the first stage, empty ones too (no letter); a text that a later stage empties stays, with an empty
text, and has one row without a bin in the last. Rows equal in id and text stay once; other texts under an id, or under none, are
documents of their own. Very long texts pass whole. An empty table gives no rows in every stage. Further columns of ``docs`` are kept
as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import langid, line_templates, minhash, packing, pii
from casebook.llm.common import table, written


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null texts, texts without a letter, and texts that no learnt language explains (none is learnt without labelled rows)."""
    learnt = docs.where(~langid.held_out())
    model = langid.fit(learnt)
    return docs.where(langid.explained(docs, model, langid.calibrated(learnt, model)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs across documents, save in the first that holds it."""
    return _measured(line_templates.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8)."""
    return minhash.one_of_each(docs)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in the place of personal data."""
    return _measured(pii.redact(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' bytes into sequences of several lengths; one row a piece."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", redaction),
    ("best-fit packing", sequences),
]

#: No stage's decisions can be written in SQL over whole tables; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
