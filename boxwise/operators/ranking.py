"""Ranking metrics: everything that follows from scores in order.

Scores are first reduced to one row for each distinct value where that is enough. Then one
sort over all partitions, with offsets from one partition to the next, gives running
totals; see boxwise.operators.ordered. No group and no score is a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.operators import ordered as O


def running(df: DataFrame, group: list[str], by: str, sums: list[str], descending: bool = False) -> DataFrame:
    """df, unique in (group, by), with cum_<s> for each sum: the total up to and with the row's own `by`."""
    return O.running_totals(O.in_order(df, group, [F.desc(by) if descending else F.asc(by)]), group, sums)


def quantiles(df: DataFrame, group: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """group..., n and a column for each wanted quantile, between the two nearest values in proportion; NULLs are left out.

    Ranks are read off running counts of distinct values, so no group is gathered.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*group, F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = running(counts, group, "v", ["c"])
    n = F.col("_n")
    at = {name: q * (n - 1) for name, q in wanted.items()}
    found = cum.join(counts.groupBy(*group).agg(F.sum("c").alias("_n")), group).groupBy(*group, "_n").agg(*(F.min(F.when(F.col("cum_c") > edge(p), F.col("v"))).alias(f"_{side}_{name}") for name, p in at.items() for side, edge in (("low", F.floor), ("high", F.ceil))))
    return found.select(*group, n.alias("n"), *((F.col(f"_low_{k}") + (F.col(f"_high_{k}") - F.col(f"_low_{k}")) * (p - F.floor(p))).alias(k) for k, p in at.items()))


def histogram(df: DataFrame, group: list[str], y: str, score: str) -> DataFrame:
    """For each group and distinct score: p positives and n negatives. Rows with a NULL or a score that is not finite are dropped."""
    x = F.col(score)
    ok = F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")) & F.col(y).isNotNull(), F.lit(False))
    return df.where(ok).groupBy(*group, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))


def auroc(df: DataFrame, group: list[str], y: str, score: str) -> DataFrame:
    """group..., auroc: the chance that a positive scores higher than a negative, ties half; NULL where either is missing."""
    cum = running(histogram(df, group, y, score), group, "score", ["n"])
    wins = F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2))
    return cum.groupBy(*group).agg(F.try_divide(wins, (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def average_precision(df: DataFrame, group: list[str], y: str, score: str) -> DataFrame:
    """group..., aupr: tie-aware, equal scores are one threshold; NULL without positives."""
    cum = running(histogram(df, group, y, score), group, "score", ["p", "n"], descending=True)
    return cum.groupBy(*group).agg(F.try_divide(F.sum(F.col("p") * F.col("cum_p") / (F.col("cum_p") + F.col("cum_n"))), F.sum("p").cast("double")).alias("aupr"))


def fpr_at_tpr(df: DataFrame, group: list[str], y: str, score: str, tpr: float = 0.95) -> DataFrame:
    """group..., fpr95: the lowest false positive rate of thresholds that reach the true positive rate; 1 if none, NULL without both kinds."""
    cum = running(histogram(df, group, y, score), group, "score", ["p", "n"], descending=True)
    totals = cum.groupBy(*group).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    joined = cum.join(totals, group)
    best = F.min(F.when(F.col("cum_p") >= tpr * F.col("tp"), F.try_divide(F.col("cum_n"), F.col("tn"))))
    return joined.groupBy(*group).agg(F.when((F.max("tp") > 0) & (F.max("tn") > 0), F.coalesce(best, F.lit(1.0))).alias("fpr95"))


def ranked(df: DataFrame, group: list[str], score: str, key: str, values: list[str], descending: bool = False) -> DataFrame:
    """group..., score, key, values..., cum_<v> and rank, in the total order (score, key).

    key makes rows unique within a group, and parts rows of one score over tasks.
    """
    x = df.select(*group, F.col(score).cast("double").alias("_score"), F.col(key).alias("_key"), *values, F.lit(1).alias("one"))
    out = O.running_totals(O.in_order(x, group, [F.desc("_score") if descending else F.asc("_score"), F.asc("_key")]), group, [*values, "one"])
    return out.select(*group, F.col("_score").alias("score"), F.col("_key").alias("key"), *values, *(f"cum_{v}" for v in values), F.col("cum_one").alias("rank"))


def average_precision_ordered(df: DataFrame, group: list[str], y: str, score: str, key: str) -> DataFrame:
    """group..., aupr_ordered: ties in the order of key; NULL with one kind alone."""
    r = ranked(df, group, score, key, [y], descending=True)
    value = F.sum(F.col(y) * F.col(f"cum_{y}") / F.col("rank")) / F.sum(y)
    return r.groupBy(*group).agg(F.when((F.sum(y) > 0) & (F.sum(y) < F.count(F.lit(1))), value).alias("aupr_ordered"))


def selective_risk(df: DataFrame, group: list[str], risk: str, uncertainty: str, key: str) -> DataFrame:
    """group..., key, rank and selective_risk: the mean risk of the rows no less certain, in the order (uncertainty, key)."""
    r = ranked(df, group, uncertainty, key, [risk])
    return r.select(*group, "key", "rank", (F.col(f"cum_{risk}") / F.col("rank")).alias("selective_risk"))


def risk_coverage(df: DataFrame, group: list[str], risk: str, uncertainty: str, key: str) -> DataFrame:
    """selective_risk() with n, the rows of the group, and coverage, rank / n."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return selective_risk(df, group, risk, uncertainty, key).join(n, group).withColumn("coverage", F.col("rank") / F.col("n"))


def aurc_mean(curve: DataFrame, group: list[str]) -> DataFrame:
    """group..., aurc: the plain mean of the selective risk."""
    return curve.groupBy(*group).agg(F.avg("selective_risk").alias("aurc"))


def aurc_trapezoid(curve: DataFrame, group: list[str]) -> DataFrame:
    """group..., aurc: the area under selective risk over coverage, by trapezoids: each inner point counts whole, both ends half."""
    first, last = F.sum(F.when(F.col("rank") == 1, F.col("selective_risk"))), F.max_by("selective_risk", "rank")
    return curve.groupBy(*group).agg(F.when(F.max("rank") > 1, (F.sum("selective_risk") - first / 2 - last / 2) / F.max("rank")).otherwise(0.0).alias("aurc"))


def risk_at(curve: DataFrame, group: list[str], coverages: list[float]) -> DataFrame:
    """group..., requested, selective_risk at rank ceil(q n), the first at least."""
    wanted = F.explode(F.array(*map(F.lit, coverages)))
    # Rounding guards against products such as 0.8 * 5 that come out a little too large.
    return curve.withColumn("requested", wanted).where(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.round(F.col("requested") * F.col("n"), 9)))).select(*group, "requested", "selective_risk")


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """group..., spearman: the correlation of mean ranks; NULL with fewer than two rows or no spread."""

    def mean_ranks(x: str) -> DataFrame:
        counts = df.groupBy(*group, F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        return running(counts, group, "v", ["c"]).select(*group, F.col("v").alias(f"_{x}"), (F.col("cum_c") - (F.col("c") - 1) / 2).alias(f"rank_{x}"))

    keyed = df.select(*group, F.col(a).cast("double").alias(f"_{a}"), F.col(b).cast("double").alias(f"_{b}"))
    both = keyed.join(mean_ranks(a), [*group, f"_{a}"]).join(mean_ranks(b), [*group, f"_{b}"])
    value = F.corr(f"rank_{a}", f"rank_{b}")
    return both.groupBy(*group).agg(F.when(F.isnan(value), None).otherwise(value).alias("spearman"))


def variants(df: DataFrame, keep: list[str], scores: dict[str, str | Column]) -> DataFrame:
    """Long form: keep..., variant, score, one row for each row and score that is not NULL."""
    items = [F.struct(F.lit(k).alias("variant"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("score")) for k, v in scores.items()]
    return df.select(*keep, F.inline(F.array(*items))).where("score is not null")
