"""Readers of the text tables: jobs, trials, scores, tags, columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.scalar import strip_prefix

JOB_HEADER = "alarm_jobfile_header"
TRIALS = ("train", "test", "comp", "iter", "batch", "rate", "decay", "a1", "a2", "b1", "b2", "dropout", "l2")


def jobs(lines: DataFrame) -> DataFrame:
    """(kind, value) of a job file's lines (value): repo and file entries; raises if the counts differ from its header."""
    head = lines.where(F.col("value").startswith(JOB_HEADER)).select(F.split("value", " ").alias("p")).first()
    found = lines.where(F.col("value").rlike("^(repo|file) ")).select(F.regexp_extract("value", "^(repo|file) ", 1).alias("kind"), F.regexp_extract("value", "^(?:repo|file) (.*)$", 1).alias("value"))
    counts = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if head is None or [int(x) for x in head.p[1:3]] != [counts.get("repo", 0), counts.get("file", 0)]:
        raise ValueError("the job file's header does not match its entries")
    return found


def trials(lines: DataFrame) -> DataFrame:
    """Trial lines: those that start ``0.`` after blanks, or ``* 0.`` for a best one; two characters, then 13 numbers."""
    hit = lines.where(F.col("value").rlike(r"^(\* |\s+)?0\.")).select(F.col("value").startswith("*").alias("best"), F.split(F.trim(F.regexp_replace("value", r"^\* ", "")), r"\s+").alias("p")).where(F.size("p") >= len(TRIALS))
    return hit.select("best", *(F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate(TRIALS)))


def full_layers(df: DataFrame) -> DataFrame:
    """Layer sizes as they are in effect: times the share that dropout keeps."""
    return df.withColumns({n: F.col(n) * F.col("dropout") for n in ("a1", "a2", "b1", "b2")})


def scores(lines: DataFrame) -> DataFrame:
    """(low, high, mean, repo) of score lines: blanks, a sign or blank, then a number below 2."""
    hit = lines.where(F.col("value").rlike(r"^  [- ][01]\.")).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 4)
    return hit.select(*(F.col("p")[i].try_cast("double").alias(n) for i, n in enumerate(("low", "high", "mean"))), F.col("p")[3].alias("repo"))


def tags(spark: SparkSession, path: str, base: str = "") -> DataFrame:
    """(class, repo) of a tag file, whose lines name a class and a file with a repository a line."""
    entries = [r.value.split(None, 1) for r in spark.read.text(path).where("trim(value) <> ''").collect()]  # a handful of classes
    out = spark.createDataFrame([], "class string, repo string")
    for name, file in entries:
        lines = spark.read.text(f"{base}{file.strip()}").where("trim(value) <> ''")
        out = out.unionByName(lines.select(F.lit(name).alias("class"), strip_prefix(F.trim("value")).alias("repo")))
    return out


def column(lines: DataFrame, index: int) -> DataFrame:
    """One column, from 0, of a table separated by blanks, as numbers."""
    return lines.select(F.split(F.trim("value"), r"\s+")[index].try_cast("double").alias("value")).where("value is not null")
