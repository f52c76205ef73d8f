"""From raw documents to a training mixture, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the one before kept, and is written
as Parquet before the next reads it. All but the last return the columns of ``documents``; the
last adds each document's token count, domain posteriors, rate, number of copies and the mixture's gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.llm import decontaminate, langid, mixing, neardup, substring_dedup
from evalgrid.llm.common import written
from evalgrid.llm.queries import BUDGET, SHARES

#: Documents whose language is no better known than this are rejected; prose in a learned language scores over 0.4.
LEAST_SCORE = 0.2
#: Words of a shingle and similarity (percent) of near duplicates, with the bands that find them.
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 26, 5


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with other names for columns that an operator's own would replace."""
    return docs.withColumnsRenamed({n: f"__own_{n}" for n in names if n in docs.columns})


def _again(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names."""
    return df.select([F.col(f"__own_{c}").alias(c) if f"__own_{c}" in df.columns else F.col(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or in no language that the labelled ones teach.

    A null or empty text has no letter and goes. Repeated rows and rows without an id or a language are judged like others (a
    null language teaches nothing), and columns of any name pass through. An empty table gives an empty one.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(_apart(docs, "lang_pred", "score"), model)
    return _again(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates.

    A row without an id, or whose text is null or has no word, is near nothing and stays. Of rows that repeat an id and a
    text one stays, the least as JSON; unlike texts that share an id stay or go together. An empty table gives an empty one.
    """
    dropped = written(neardup.component_table(docs, SHINGLE, PERCENT, BANDS, ROWS).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "dropped")
    out = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    row = F.struct(*docs.columns)
    once = out.join(repeated, "doc_id", "left_anti").select(docs.columns)
    first = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__sign")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.unionByName(first.select("__row.*").select(docs.columns))


def first_occurrences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines and sentences out of the texts; documents of which nothing remains go.

    Null and empty texts have nothing to cut and stay. Rows that repeat id and text are one document, and rows without an id come before
    all others. ``n_chars`` is counted anew. An empty table gives an empty one.
    """
    cut = substring_dedup.deduplicated(_apart(docs, "removed"))
    emptied = F.col("removed").isNotNull() & (F.trim(F.col("text")) == "")
    kept = cut.where(~emptied)
    return _again(kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or edited.

    Null and empty texts hold none and stay, as do all if the benchmark is empty; repeated rows are judged alike. An empty table gives an empty one.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document its rate and number of copies in the mixture; those with none go.

    A null or empty text has no tokens and keeps the rate 1. Without labels all documents are alike, and ``gap`` tells how far the targets
    stay out of reach. Columns named like the new ones are replaced. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed(docs, labels, SHARES, BUDGET).where("n_copies > 0")


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", first_occurrences),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: Components, alignments and gradient steps are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
