"""Appending, upserting and incremental filling of tables kept as Parquet."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.sources.files import exists


def project_onto(df: DataFrame, header: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with exactly the header's columns (missing ones null), and the names that fall away."""
    dropped = [c for c in df.columns if c not in header]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header]), dropped


def append_rows(df: DataFrame, path: str, header: list[str]) -> list[str]:
    """Appends to a table under its header; returns the columns that were not written."""
    out, dropped = project_onto(df, header)
    out.write.mode("append").parquet(path)
    return dropped


def upsert(old: DataFrame, new: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Old entries and the new ones; an entry that differs from the old one under its key is refused unless forced."""
    values = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    if not force:
        present = F.col(f"o.{values[0]}").isNotNull() & F.col(f"n.{values[0]}").isNotNull()
        differs = F.lit(False)
        for c in values:
            differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        if not both.where(present & differs).isEmpty():
            raise ValueError(f"an entry differs under its {key}")
    return both.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in values])


def missing(wanted: DataFrame, filled: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to be computed."""
    return wanted.join(filled.select(*keys), keys, "left_anti")


def _swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts a finished folder in the place of an old one."""
    jvm, old = spark._jvm, f"{path}.{uuid.uuid4().hex}.old"
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.mkdirs(at(path).getParent())
    if not fs.rename(at(new), at(path)):
        raise OSError(f"{path} could not be put in place")
    fs.delete(at(old), True)


def save(df: DataFrame, path: str, how: str = "json") -> None:
    """Writes a table beside ``path`` and then puts it there, so a reader sees the old one or the new one; NaN is saved as null."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    out = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns])
    new = f"{path}.{uuid.uuid4().hex}.new"
    out.write.format(how).option("ignoreNullFields", "false").save(new)
    _swap(df.sparkSession, new, path)


def load(spark: SparkSession, path: str, schema: str, how: str = "json") -> DataFrame:
    """A saved table, or none if there is none yet."""
    return spark.read.schema(schema).format(how).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def fill(wanted: DataFrame, path: str, keys: list[str], evaluate, pieces: int = 1) -> DataFrame:
    """Computes what a saved table lacks, and saves after each of ``pieces`` parts, so a run that broke off goes on where it stood.

    ``evaluate`` gets the rows of ``wanted`` still to be done and returns them with their results.
    """
    spark = wanted.sparkSession
    for part in range(pieces):
        todo = wanted if not exists(spark, path) else missing(wanted, spark.read.parquet(path), keys)
        own = todo.where(F.pmod(F.xxhash64(*keys), F.lit(pieces)) == part) if pieces > 1 else todo
        evaluate(own).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def memoised(df: DataFrame, path: str, content: Column, compute) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``key`` (the content's hash) and ``hit``, and the cache it is answered from; content that the cache lacks is computed once a key and appended.

    ``compute`` gets distinct ``key, content`` and returns ``key`` with its values.
    """
    spark = df.sparkSession
    keyed = df.withColumn("key", F.sha1(content.cast("binary")))
    if exists(spark, path):
        known = spark.read.parquet(path).select("key")
        hits = keyed.join(known.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    else:
        hits = keyed.withColumn("hit", F.lit(False))
    compute(hits.where("NOT hit").select("key", content.alias("content")).groupBy("key").agg(F.first("content").alias("content"))).write.mode("append").parquet(path)
    return hits, spark.read.parquet(path)


def build_corpus(samples: DataFrame, expected: DataFrame, path: str, cell: str = "cell") -> DataFrame:
    """Writes a corpus with a folder a cell, and beside it the side-car ``stats``: expected and emitted samples of each cell and whether it was skipped.

    ``expected`` has a row a cell (``cell, n_episodes, n_expected``). Without any sample at all there is no corpus (ValueError);
    where fewer were emitted than expected a warning names the cells. The side-car doubles as the manifest of what was written.
    """
    spark = samples.sparkSession
    if samples.isEmpty():
        raise ValueError("nothing was selected for the corpus")
    samples.write.partitionBy(cell).json(f"{path}/samples")
    written = spark.read.json(f"{path}/samples").groupBy(cell).agg(F.count("*").alias("n_samples"))  # counts what is there, not what was sent
    stats = expected.join(written, cell, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    stats = stats.withColumn("skipped", F.col("n_samples") == 0).withColumn("folder", F.when(~F.col("skipped"), F.concat(F.lit(f"{cell}="), F.col(cell))))
    save(stats, f"{path}/stats")
    short = [r[cell] for r in stats.where("n_samples < n_expected").select(cell).orderBy(cell).collect()]  # a row a cell
    if short:
        warnings.warn(f"fewer samples than expected in {', '.join(map(str, short))}", stacklevel=2)
    return spark.read.schema(stats.schema).json(f"{path}/stats")


def check_shapes(sites: DataFrame, rank: int, d_in: int, d_out: int) -> DataFrame:
    """Sites (``site, a, b``) whose factors fit: a of rank x d_in and b of d_out x rank numbers. One that doesn't, or no site at all, raises ValueError."""
    counts = sites.agg(F.count("*").alias("n"), F.count_if((F.size("a") != rank * d_in) | (F.size("b") != d_out * rank)).alias("bad")).first()
    if not counts["n"] or counts["bad"]:
        raise ValueError(f"{counts['bad']} of {counts['n']} sites don't have the shapes {rank} x {d_in} and {d_out} x {rank}")
    return sites


def preserved_scale(alpha: Column, rank: Column, out_rank: Column, served: Column) -> tuple[Column, Column]:
    """The alpha that keeps alpha / rank at another rank, and the served scale as a share of the trained one."""
    return alpha * out_rank / rank, (served / out_rank) / (alpha / rank)


def require_preserved(df: DataFrame, ratio: str, tolerance: float = 1e-6) -> DataFrame:
    """``df``, or ValueError if any ratio is off by more than the tolerance."""
    if not df.where(F.abs(F.col(ratio) - 1) > tolerance).isEmpty():
        raise ValueError(f"a served scale differs from the trained one by more than {tolerance}")
    return df
