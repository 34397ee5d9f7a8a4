"""Resumable setting searches.

A search is a list of settings times folds. Every finished fit is one row of a results table in
shared storage, named by a hash of the setting, the fold and the data's name; a search that starts again skips what is there,
so a lost driver costs the fits that were running. Folds are assigned and stored once. Several fits
run at a time, each a Spark job of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "name string, setting string, fold int, n long, r2 double, rmse double, seconds double"


def grid(**choices: Sequence) -> list[dict]:
    """Every combination of the choices."""
    return [dict(zip(choices, values, strict=True)) for values in itertools.product(*choices.values())]


def drawn(settings: list[dict], n: int, seed: int = 42) -> list[dict]:
    """``n`` settings drawn without repeats by a seed."""
    return random.Random(seed).sample(settings, min(n, len(settings)))


def around(best: dict, steps: dict[str, Sequence]) -> list[dict]:
    """A grid centred on a setting. ``steps`` has, per name, what to add (whole numbers) or to multiply by
    (fractions); names without steps stay. Whole numbers stay at 1 or more."""
    choices = {}
    for name, value in best.items():
        if name not in steps:
            choices[name] = [value]
        elif isinstance(value, int):
            choices[name] = sorted({max(1, value + s) for s in steps[name]})
        else:
            choices[name] = sorted({value * s for s in steps[name]})
    return grid(**choices)


def fit_name(setting: dict, fold: int, data: str) -> str:
    return hashlib.sha256(json.dumps([data, setting, fold], sort_keys=True).encode()).hexdigest()


class SearchLog:
    """The results table of a search: one folder with one row per finished fit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], RESULTS)
        # a fit that ran twice has two equal names
        return self.spark.read.schema(RESULTS).option("recursiveFileLookup", True).parquet(self.path).dropDuplicates(["name"])

    def names(self) -> set[str]:
        return {r["name"] for r in self.rows().select("name").collect()}

    def add(self, row: tuple) -> None:
        # a folder of its own, so that fits that end at the same time do not share a writer's folder
        self.spark.createDataFrame([row], RESULTS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{row[0]}")


def run_search(log: SearchLog, folded: DataFrame, fold: str, settings: Sequence[dict],
               fit_and_score: Callable[[DataFrame, DataFrame, dict], dict], data: str = "", parallelism: int = 4) -> int:
    """Fits every setting on every fold that the log does not have yet; returns how many fits it ran.

    ``fit_and_score(train, held_out, setting)`` returns ``n``, ``r2`` and ``rmse`` of the held-out rows. ``folded`` is
    read by every fit and should be stored; ``data`` names it, so that results of other data do not count."""
    folds = sorted(r[0] for r in folded.select(fold).distinct().collect())
    there = log.names()
    todo = [(s, f, fit_name(s, f, data)) for s in settings for f in folds]
    todo = [t for t in todo if t[2] not in there]

    def one(task: tuple) -> None:
        setting, f, name = task
        began = time.perf_counter()
        got = fit_and_score(folded.where(F.col(fold) != f), folded.where(F.col(fold) == f), setting)
        log.add((name, json.dumps(setting, sort_keys=True), int(f), int(got["n"]), float(got["r2"]), float(got["rmse"]),
                 time.perf_counter() - began))

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(one, todo))
    return len(todo)


def summary(log: SearchLog, settings: Sequence[dict], data: str = "", folds: Sequence[int] = ()) -> DataFrame:
    """One row per setting of this search: ``setting, folds, n, mean_r2, std_r2, mean_rmse, chosen``; the best mean
    R2 is chosen, ties by the setting's text."""
    names = [(fit_name(s, f, data),) for s in settings for f in folds]
    mine = log.spark.createDataFrame(names, "name string")
    each = log.rows().join(mine, "name").groupBy("setting").agg(
        F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
        F.avg("rmse").alias("mean_rmse"))
    best = each.orderBy(F.desc("mean_r2"), "setting").limit(1).select(F.col("setting").alias("__best"))
    return each.join(F.broadcast(best), F.col("setting") == F.col("__best"), "left").withColumn(
        "chosen", F.col("__best").isNotNull()).drop("__best")


def best_setting(table: DataFrame) -> dict:
    return json.loads(table.where("chosen").first()["setting"])
