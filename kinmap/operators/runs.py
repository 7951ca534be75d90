"""Analytics of run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ["algo", "use_attr", "dataset", "train_ratio", "seed"]


def best_epochs(runs: DataFrame, metric: str = "mrr") -> DataFrame:
    """The epoch of the best metric of each run (the first of equals) and its last epoch."""
    best = F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch")))
    return runs.groupBy(*RUN).agg(best.alias("best_epoch"), F.max(metric).alias(metric), F.max("epoch").alias("last_epoch"), F.max_by(metric, "epoch").alias(f"last_{metric}"))


def over_seeds(runs: DataFrame, metric: str = "mrr") -> DataFrame:
    """(algo, use_attr, dataset, runs, mean_best, std_best)."""
    return runs.groupBy("algo", "use_attr", "dataset").agg(F.count("*").alias("runs"), F.avg(metric).alias("mean_best"), F.stddev_samp(metric).alias("std_best"))


def robustness(trials: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric over the trials of each algorithm, kind of noise and level."""
    return trials.groupBy("algo", "noise", "level").agg(F.count("*").alias("trials"), F.avg(metric).alias(metric))
