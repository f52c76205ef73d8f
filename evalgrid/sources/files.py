"""Files of results: discovering and reading trial tables, summaries, task lists, splits, episodes and adapters.

Readers take paths that any Spark reader opens; a table may be one file or a folder that Spark wrote. Listing is Spark's own, and
names, folders and times come from ``_metadata``, so nothing is walked on the driver.
"""

from __future__ import annotations

import csv
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Fixed patterns of names: trial tables, tasks, and episode folders with time, task, seed and repeat.
TRIAL, TASK, STAMP, EPISODE = r"result_df_trial_(\d+)_of_(\d+)\.csv", r"run\.(\d+)", r"^\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}_", r"_on_run\.(\d+)_(\d+)(?:_(\d+))?$"


def work_dir(spark: SparkSession, name: str, within: str | None = None) -> str:
    """A new folder under ``within`` or the one that driver and executors share (``spark.checkpoint.dir``); a temporary one on a single machine where none is set."""
    top = within or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="files-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or ``within``) and read again, where several steps use it."""
    path = work_dir(df.sparkSession, name, within)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounds(df: DataFrame, key: str, size: int, within: str) -> Iterator[tuple[DataFrame, bool]]:
    """``df`` in parts of about ``size`` rows, dealt by the hash of ``key``, every row in one of them; and whether it is the last part.

    The rows are dealt once, and each part is read from files of its own, so many parts cost no more reading than one. What was shuffled before a part,
    for the rows or by the jobs on other parts, goes first.
    """
    spark = df.sparkSession
    whole = kept(df, "whole", within)
    n = max(1, -(-whole.count() // size))
    path = work_dir(spark, "rounds", within)
    whole.withColumn("__round", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("__round").write.partitionBy("__round").parquet(path)
    dealt = spark.read.schema(StructType([*df.schema.fields, StructField("__round", IntegerType())])).parquet(path)
    for k in range(n):
        gc.collect()
        spark._jvm.System.gc()  # Spark keeps shuffle files until the frames that made them are collected
        yield dealt.where(F.col("__round") == k).drop("__round"), k == n - 1


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``work_dir`` gave, with all in it; nothing is done if it is gone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, at`` of every file below ``root`` that isn't hidden; none if there is no such folder."""
    if not exists(spark, root):
        return spark.createDataFrame([], "path string, at timestamp")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("at"))


def read_tables(spark: SparkSession, root: str, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` as text, with ``__path`` and ``__at``, of all CSV files whose path fits; files may differ in their columns, and those that one lacks are null.

    Files are read together by their header lines, of which there are few kinds; the driver sees a path and a header of each.
    """
    found = listed(spark, root).where(F.rlike("path", F.lit(pattern)))
    paths = [r["path"] for r in found.select("path").orderBy("path").collect()]
    out = spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "__path string", "__at timestamp"]))
    if not paths:
        return out
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    kinds: dict[str, list[str]] = {}
    for r in lines.groupBy("path").agg(F.min_by("value", "place").alias("header")).orderBy("path").collect():
        kinds.setdefault(r["header"], []).append(r["path"])
    for header, own in kinds.items():
        names = next(csv.reader([header.lstrip("\ufeff")]))
        schema = StructType([StructField(n if n and names.index(n) == i else f"__{i}", StringType()) for i, n in enumerate(names)])
        raw = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(own)
        have = [F.col(f"`{c}`") if c in names else F.lit(None).cast("string").alias(c) for c in columns]
        out = out.unionByName(raw.select(*have, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_modification_time").alias("__at")))
    return out


def as_double(column: str, default: float = 0.0) -> Column:
    """A number, or the default where the text is none."""
    return F.coalesce(F.expr(f"try_cast(trim(`{column}`) AS double)"), F.lit(default))


def as_long(column: str, default: int = 0) -> Column:
    """A whole number, by way of a double."""
    return F.coalesce(F.expr(f"try_cast(try_cast(trim(`{column}`) AS double) AS bigint)"), F.lit(default).cast("long"))


def as_flag(column: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(f"`{column}`"))).isin("true", "1", "yes"), F.lit(False))


def text_of(column: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{column}`"), F.lit("")))


def trial_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, study_dir, trial, of`` of every trial table below ``root``, at any depth, once each, in the order they were run."""
    table = F.regexp_extract("path", rf"^(.*{TRIAL})(?:/[^/]*)?$", 1)
    own = listed(spark, root).select(table.alias("path"), "at").where("path <> ''").groupBy("path").agg(F.max("at").alias("at"))
    own = own.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("study_dir"), F.regexp_extract("path", TRIAL, 1).cast("int").alias("trial"), F.regexp_extract("path", TRIAL, 2).cast("int").alias("of"), "at")
    begun = own.groupBy("study_dir").agg(F.min("at").alias("begun"))
    return own.join(begun, "study_dir").orderBy("begun", "study_dir", "trial").select("path", "study_dir", "trial", "of")


#: Columns of a trial table; those that a file lacks are null.
COLUMNS = ("exp_dir", "env.task_name", "exp_name", "env.task_seed", "cum_reward", "cum_raw_reward", "n_steps", "err_msg", "terminated", "truncated")


def read_trials(spark: SparkSession, root: str) -> DataFrame:
    """A record for each episode below ``root``, the row of its last trial, with ``n_attempts``.

    An episode is known by its folder's name without the time; a row without a folder is an episode of its own. Numbers
    that can't be read count as 0 (a seed as -1), and half-written or missing tables give what they have.
    """
    rows = read_tables(spark, root, TRIAL, COLUMNS)
    rows = rows.select(F.regexp_extract("__path", rf"^(.*)/[^/]*{TRIAL}", 1).alias("study_dir"), F.regexp_extract("__path", TRIAL, 1).cast("int").alias("trial"), *[f"`{c}`" for c in COLUMNS])
    name = F.coalesce(F.nullif(text_of("env.task_name"), F.lit("")), text_of("exp_name"))
    base = F.regexp_replace(F.regexp_extract(F.rtrim(text_of("exp_dir"), F.lit("/")), r"([^/]*)$", 1), STAMP, "")
    part = lambda i: F.nullif(F.regexp_extract("base", EPISODE, i), F.lit("")).cast("long")
    r = rows.withColumn("name", name).withColumn("base", base).withColumn("folder", text_of("exp_dir"))
    r = r.select(
        "study_dir", "trial", "folder", "name", F.when(F.col("folder") != "", F.col("base")).otherwise(F.concat(F.lit("?"), F.expr("uuid()"))).alias("episode"),
        F.coalesce(part(1), F.nullif(F.regexp_extract("name", TASK, 1), F.lit("")).cast("long")).alias("task_id"), F.coalesce(part(2), as_long("env.task_seed", -1)).alias("seed"), F.coalesce(part(3), F.lit(0)).alias("repeat"),
        as_double("cum_reward").alias("reward"), as_double("cum_raw_reward").alias("raw_reward"), as_long("n_steps").alias("n_steps"),
        as_flag("terminated").alias("terminated"), as_flag("truncated").alias("truncated"), (text_of("err_msg") != "").alias("err"), F.left(text_of("err_msg"), F.lit(400)).alias("err_msg"))
    values = [c for c in r.columns if c not in ("study_dir", "episode")]
    last = r.groupBy("study_dir", "episode").agg(F.max_by(F.struct(*values), F.struct("trial", "folder")).alias("r"), F.greatest(F.lit(1), F.count_distinct(F.nullif("folder", F.lit("")))).alias("n_attempts"), F.count("*").alias("n_rows"))
    return last.select("study_dir", "r.*", "n_attempts", "n_rows")


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """``study_dir`` and the columns of the harness's own summary: the file named exactly so if there is one, else the newest; its last row."""
    rows = read_tables(spark, root, r"summary_df[^/]*\.csv", ("avg_reward", "std_err", "n_completed", "n_err"))
    rows = rows.withColumn("study_dir", F.regexp_extract("__path", r"^(.*)/[^/]*summary_df[^/]*\.csv", 1)).withColumn("__exact", F.rlike("__path", F.lit(r"summary_df\.csv"))).withColumn("__place", F.monotonically_increasing_id())
    first = Window.partitionBy("study_dir").orderBy(F.desc("__exact"), F.desc("__at"), F.desc("__path"), F.desc("__place"))
    chosen = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return chosen.select("study_dir", as_double("avg_reward").alias("avg_reward"), as_double("std_err").alias("std_err"), "n_completed", as_long("n_err").alias("n_err"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, an object with ``tasks``, or a record a line; blank lines are skipped, and a missing file has no record."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    kind = F.when(F.startswith("v", F.lit("[")), "array").when(F.rlike("v", F.lit(r'^\{\s*"tasks"\s*:')), "tasks").otherwise("lines")
    each = whole.withColumn("kind", kind)
    arrays = each.where("kind = 'array'").select(F.explode(F.from_json("v", f"array<struct<{schema_of(schema)}>>")).alias("r"))
    tasks = each.where("kind = 'tasks'").select(F.explode(F.from_json("v", f"struct<tasks: array<struct<{schema_of(schema)}>>>").getField("tasks")).alias("r"))
    lines = each.where("kind = 'lines'").select(F.explode(F.split("v", "\n")).alias("line")).where(F.trim("line") != "").select(F.from_json("line", f"struct<{schema_of(schema)}>").alias("r"))
    return arrays.unionByName(tasks).unionByName(lines).select("r.*")


def schema_of(columns: str) -> str:
    """A struct's fields from a list of columns."""
    return ", ".join(f"{c.strip().split(' ', 1)[0]}: {c.strip().split(' ', 1)[1]}" for c in columns.split(","))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``task_id, sites, split`` of a split table with quoted commas; the id comes from the task's name, else from its column. The last row of a task wins."""
    raw = spark.read.option("header", "true").option("quote", '"').csv(path)
    task = F.coalesce(F.nullif(F.regexp_extract("task_name", TASK, 1), F.lit("")).cast("long"), as_long("task_id", -1))
    row = raw.select(task.alias("task_id"), "sites", F.col("browsergym_split").alias("split"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("at"))
    return row.groupBy("task_id").agg(F.max_by(F.struct("sites", "split"), "at").alias("r")).select("task_id", "r.*")


def scan_episodes(spark: SparkSession, root: str) -> DataFrame:
    """``name, task_id, seed, reward, n_steps, dumps`` of every episode folder below ``root``: its summary, and how many step dumps it has; by name."""
    files = listed(spark, root)
    name = F.regexp_extract("path", r"/([^/]*_on_run\.\d+_\d+(?:_\d+)?)/", 1)
    dumps = files.select(name.alias("name"), F.rlike("path", F.lit(r"/agent_output_step_\d+\.(?:json|txt)")).alias("dump")).where("name <> ''").groupBy("name").agg(F.count_if("dump").alias("dumps"))
    raw = spark.read.schema("cum_reward double, n_steps long").option("recursiveFileLookup", "true").json(root)
    summary = raw.where(F.rlike(F.col("_metadata.file_path"), F.lit(r"/summary_info\.json"))).select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*_on_run\.\d+_\d+(?:_\d+)?)/", 1).alias("name"), F.col("cum_reward").alias("reward"), "n_steps")
    part = lambda i: F.regexp_extract("name", EPISODE, i).cast("long")
    return dumps.join(summary, "name", "left").select("name", part(1).alias("task_id"), part(2).alias("seed"), "reward", "n_steps", "dumps").orderBy("name")
