"""Signals of the change history: churn, co-change, hotness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T

#: Sizes of commits that count for co-change, partners kept.
LEAST_FILES, MOST_FILES, PARTNERS = 2, 50, 8


def file_stats(commits: DataFrame) -> DataFrame:
    """file, churn (commits), last_commit of commits (commit_id, ts, file)."""
    return commits.select("commit_id", "ts", "file").distinct().groupBy("file").agg(F.countDistinct("commit_id").alias("churn"), F.max("ts").alias("last_commit"))


def co_change(commits: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """file, partner, n: files changed together most often. Sweeping commits are left out before pairing."""
    pairs = commits.select("commit_id", "file").distinct()
    sizes = pairs.groupBy("commit_id").agg(F.count(F.lit(1)).alias("files")).where(F.col("files").between(LEAST_FILES, MOST_FILES))
    listed = pairs.join(sizes, "commit_id").groupBy("commit_id").agg(F.collect_list("file").alias("fs"))  # at most MOST_FILES each
    both = listed.select(F.explode("fs").alias("file"), "fs").select("file", F.explode("fs").alias("partner")).where("file <> partner")
    counts = both.groupBy("file", "partner").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("file").orderBy(F.desc("n"), "partner")
    return counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= partners).drop("_r")


def co_change_of(files: DataFrame, together: DataFrame, most: int = 5) -> DataFrame:
    """partner, n of a set of files (file): the highest count per partner outside the set."""
    own = files.select("file").distinct()
    best = together.join(own, "file", "left_semi").groupBy("partner").agg(F.max("n").alias("n"))
    return best.join(own.withColumnRenamed("file", "partner"), "partner", "left_anti").orderBy(F.desc("n"), "partner").limit(most)


def hot_files(stats: DataFrame, now: int) -> DataFrame:
    """file_path, hot from :func:`file_stats` at epoch second ``now``."""
    most = stats.agg(F.greatest(F.max("churn"), F.lit(1)).alias("max_churn")).withColumn("_one", F.lit(1))  # one row
    age = (F.lit(now) - F.col("last_commit")) / 86400
    return stats.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").select(F.col("file").alias("file_path"), F.round(T.hotness(age, F.col("churn"), F.col("max_churn")), 6).alias("hot"))
