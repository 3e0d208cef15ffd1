"""Grouped statistics: vector means, bins, histograms, rolling values, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions import scalars as S
from boxwise.operators import ranking as R


def vector_mean(df: DataFrame, group: list[str], x: str, divide_by: int = 1) -> DataFrame:
    """group..., n and m: the mean of array x by element (A2). Both levels are partial aggregates, so a hot class costs a row a task and element.

    divide_by: divides the means again, as by the number of layers where counts ran once a layer.
    """
    parts = df.select(*group, F.posexplode(x).alias("_i", "_x")).groupBy(*group, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    gathered = parts.groupBy(*group).agg(F.max("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return gathered.select(*group, "n", F.transform("_v", lambda v: v["_m"] / divide_by).alias("m"))


def two_level_mean(df: DataFrame, inner: list[str], group: list[str], x: str) -> DataFrame:
    """The mean over `inner` keys of their own means, by group (A3)."""
    return vector_mean(vector_mean(df, [*group, *inner], x).withColumnRenamed("m", "_inner").drop("n"), group, "_inner")


def merge_partials(partials: DataFrame, group: list[str]) -> DataFrame:
    """group..., n and mean of partial (total, n) rows."""
    return partials.groupBy(*group).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n").cast("double")).alias("mean"))


def heterogeneity(stats: DataFrame, least: int = 20) -> DataFrame:
    """n_classes, between, within, ratio and verdict of class statistics (n, mean, std)."""
    row = stats.where(F.col("n") >= least).agg(F.count(F.lit(1)).alias("n_classes"), F.stddev_pop("mean").alias("between"), F.sqrt(F.sum(F.col("n") * F.col("std") * F.col("std")) / F.sum("n")).alias("within"))
    ratio = F.when(F.col("within") > 0, F.col("between") / F.col("within"))
    return row.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") >= 1.0, "high").when(F.col("ratio") >= 0.5, "moderate").otherwise("low"))


def equal_bins(df: DataFrame, group: list[str], order: list[Column], bins: int) -> DataFrame:
    """df with bin from 1: `bins` bins of equal count in each group, the first ones larger by one."""
    return df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*group).orderBy(*order)))


def ranked_bins(df: DataFrame, group: list[str], x: str, key: str, values: list[str], bins: int) -> DataFrame:
    """group..., score (x), key, values... and bin, the same bins as equal_bins() in the order (x, key), for groups of any size."""
    r = R.ranked(df, group, x, key, values)
    joined = r.join(r.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), group)
    size, larger = F.floor(F.col("_n") / bins), F.col("_n") % bins
    place = F.col("rank") - 1
    bin_ = F.when(place < larger * (size + 1), F.floor(place / (size + 1))).otherwise(larger + F.floor((place - larger * (size + 1)) / size))
    return joined.select(*group, "score", "key", *values, (bin_ + 1).cast("int").alias("bin"))


def histogram(df: DataFrame, group: list[str], x: str, low: float, high: float, bins: int, kind: str = "count") -> DataFrame:
    """group..., bin (from 0), n and value: 'share' n over the total, 'density' that over the bin's width, 'count' n.

    The last bin holds its right edge; values outside of [low, high] are left out.
    """
    width = (high - low) / bins
    inside = df.where((F.col(x) >= low) & (F.col(x) <= high))
    bucket = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*group, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_t")) if group else counts.agg(F.sum("n").alias("_t"))
    joined = counts.join(totals, group) if group else counts.crossJoin(totals)  # one row
    value = {"count": F.col("n").cast("double"), "share": F.col("n") / F.col("_t"), "density": F.col("n") / (F.col("_t") * width)}[kind]
    return joined.select(*group, "bin", "n", value.alias("value"))


def rolling(df: DataFrame, group: list[str], order: list[Column], x: str, size: int = 20) -> DataFrame:
    """df with median (the lower middle), avg, max, value of the last `size` rows, and global_avg of all so far."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(size - 1), 0)
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.sort_array(F.collect_list(x).over(frame))
    return df.withColumns(
        {
            "median": F.get(last, ((F.size(last) - 1) / 2).cast("int")),
            "avg": F.avg(x).over(frame),
            "max": F.max(x).over(frame),
            "value_now": F.col(x),
            "global_avg": F.avg(x).over(so_far),
        }
    )


def ema(df: DataFrame, group: list[str], order: list[str], x: str, decay: float = 0.9999, warmups: float = 2000.0) -> DataFrame:
    """group..., n and ema: the average with decay * (1 - exp(-t / warmups)) at step t, from the first value on.

    A value's weight is the product of the later decays, so the fold is written as sums of
    logarithms over a window and one aggregate.
    """
    t = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    d = F.when(F.col("_t") > 0, decay * (1 - F.exp(-F.col("_t") / warmups)))
    later = Window.partitionBy(*group).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    weighted = df.withColumn("_t", t).withColumn("_d", d).withColumn("_w", F.exp(F.coalesce(F.sum(F.log("_d")).over(later), F.lit(0.0))) * F.when(F.col("_t") > 0, 1 - F.col("_d")).otherwise(1.0))
    return weighted.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_w") * F.col(x)).alias("ema"))


def warmup_factor(step: Column, duration: int) -> Column:
    """min(1, (t + 1) / D)."""
    return F.least(F.lit(1.0), (step + 1) / F.lit(float(duration)))


def mixed(key: Column, seed: int) -> Column:
    """A portable mix of an integer key: the same in any engine with 64-bit integers, for |key| up to 3e9."""
    return F.pmod(key * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def split(df: DataFrame, key: str, fraction: float, seed: int, most: int | None = None) -> DataFrame:
    """key and split, 'calibration' or 'frechet' (X1): disjoint, deterministic, both non-empty; key is unique, two rows at least.

    The pool is the first `most` rows in the order of a mixed key; the first bround(fraction *
    pool) of it, one at least and not all, are for calibration. The cut is found from the
    counts of BANDS ranges of the mix, so no row leaves its task but those of one range.
    """
    bands = 1024
    rows = df.select(key, mixed(F.col(key), seed).alias("_m")).withColumn("_band", F.shiftright("_m", 22))
    sizes = sorted((r["_band"], r["count"]) for r in rows.groupBy("_band").count().collect())  # at most `bands` rows
    assert len(sizes) <= bands
    total = sum(n for _, n in sizes)
    pool = min(most, total) if most is not None else total
    if pool < 2 or not 0 < fraction < 1:
        raise ValueError("a split needs two rows and a fraction within (0, 1)")
    take = min(max(1, round(fraction * pool)), pool - 1)
    starts, before = [], 0
    for band, n in sizes:
        starts.append((band, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_band long, _before long")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_band").orderBy("_m", key))
    ranked = rows.join(F.broadcast(offsets), "_band").withColumn("_k", place).where(F.col("_k") <= pool)
    return ranked.select(key, F.when(F.col("_k") <= take, "calibration").otherwise("frechet").alias("split"))


def bernoulli(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """df with chosen: whether the mixed key is below the share."""
    return df.withColumn("chosen", mixed(F.col(key), seed) < int(share * 4294967296))


def gaussian_metrics(rows: DataFrame, errors: str, logvars: str, levels: dict[str, float], names: list[str]) -> DataFrame:
    """One row a nominal level, of arrays of errors and log variances with one element for each of names.

    coordinate: the share of coordinates within z deviations; whole: that of rows with all
    of them; nll: the mean Gaussian negative log likelihood; and rmse_<name> and
    mean_std_<name>. One pass, whatever the number of levels.
    """
    e, v = F.col(errors), F.col(logvars)
    ratio = F.zip_with(e, v, lambda a, b: F.abs(a) / F.exp(b / 2))
    nll = F.zip_with(e, v, lambda a, b: S.gaussian_nll(a, b))
    n = len(names)
    within = lambda z: F.size(F.filter("_r", lambda r: r <= z)) / n
    sums = {f"_in_{k}": F.avg(within(z)) for k, z in levels.items()} | {f"_all_{k}": F.avg((F.array_max("_r") <= z).cast("int")) for k, z in levels.items()}
    sums |= {"nll": F.avg(S.total(nll) / n)}
    sums |= {f"rmse_{c}": F.sqrt(F.avg(e[i] * e[i])) for i, c in enumerate(names)} | {f"mean_std_{c}": F.avg(F.exp(v[i] / 2)) for i, c in enumerate(names)}
    one = rows.withColumn("_r", ratio).agg(*(x.alias(k) for k, x in sums.items()))
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("nominal"), F.col(f"_in_{k}").alias("coordinate"), F.col(f"_all_{k}").alias("whole")) for k in levels)))
    return one.select(each, "nll", *(f"rmse_{c}" for c in names), *(f"mean_std_{c}" for c in names))
