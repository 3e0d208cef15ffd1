"""Scalar and vector expressions on model outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(p: Column, eps: float = 1e-5) -> Column:
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.log(F.greatest(q, F.lit(eps)) / F.greatest(1 - q, F.lit(eps)))


def log_sigmoid(x: Column) -> Column:
    """log(sigmoid(x)) without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for the row, however often the body, or a lambda in it, names it."""
    return F.transform(F.array(value), body)[0]


def softmax(xs: Column) -> Column:
    exps = bound(F.array_max(xs), lambda most: F.transform(xs, lambda x: F.exp(x - most)))
    return bound(exps, lambda es: bound(total(es), lambda whole: F.transform(es, lambda e: e / whole)))


def argmax(xs: Column) -> Column:
    """Index of the largest element, the first of equal ones."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """Whether x is a number that is neither NaN nor infinite; false for NULL."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def deviations(logvars: Column, low: float = -10.0, high: float = 4.0) -> Column:
    """Standard deviations of an array of log variances, clamped first."""
    return F.transform(logvars, lambda v: F.exp(clamp(v, low, high) / 2))


def uncertainty(logvars: Column, mode: str) -> Column:
    """One number for an array of log variances: 'mean_std', 'max_std' or 'logdet'."""
    if mode == "mean_std":
        return total(deviations(logvars)) / F.size(logvars)
    if mode == "max_std":
        return F.array_max(deviations(logvars))
    if mode == "logdet":
        return total(F.transform(logvars, lambda v: clamp(v, -10.0, 4.0)))
    raise ValueError(f"unknown mode {mode!r}")


def rms_distance(a: Column, b: Column) -> Column:
    """Root mean square difference of two arrays of one length."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a))


def percentile_of(x: Column, reference: Column) -> Column:
    """Share of an array of references that are at most x; NULL without references."""
    return F.when(F.size(reference) > 0, F.size(F.filter(reference, lambda r: r <= x)) / F.size(reference))


def focal(logit: Column, target: Column, alpha: float, gamma: float) -> Column:
    p = sigmoid(logit)
    cross = -(target * log_sigmoid(logit) + (1 - target) * log_sigmoid(-logit))
    miss = 1 - (p * target + (1 - p) * (1 - target))
    return (alpha * target + (1 - alpha) * (1 - target)) * F.pow(miss, F.lit(gamma)) * cross


def varifocal(logit: Column, target: Column, quality: Column, alpha: float, gamma: float) -> Column:
    """quality: the score that a positive should have, such as its IoU; 0 for a negative."""
    goal = quality * target
    weight = alpha * F.pow(sigmoid(logit), F.lit(gamma)) * (1 - target) + goal
    return -weight * (goal * log_sigmoid(logit) + (1 - goal) * log_sigmoid(-logit))


def focal_cost(p: Column, alpha: float, gamma: float) -> Column:
    """Class cost of assigning a query with probability p to a target."""
    positive = alpha * F.pow(1 - p, F.lit(gamma)) * -F.log(p + 1e-8)
    negative = (1 - alpha) * F.pow(p, F.lit(gamma)) * -F.log(1 - p + 1e-8)
    return positive - negative


def gaussian_nll(error: Column, logvar: Column, constant: bool = True) -> Column:
    """Per coordinate; with the constant log(2 pi) or without."""
    return 0.5 * (error * error * F.exp(-logvar) + logvar + (1.8378770664093453 if constant else 0.0))


def fixed4(x: Column) -> Column:
    """Four decimals as text, halves away from zero; empty for NULL and numbers that are not finite."""
    return F.when(finite(x), F.format_string("%.4f", x)).otherwise(F.lit(""))


def parse_float(text: Column) -> Column:
    """A finite number, or NULL for anything else."""
    return finite_or_null(text.try_cast("double"))


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def slug(text: Column) -> Column:
    """Letters and digits kept, each run of anything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def duration(seconds: Column) -> Column:
    """h:mm:ss of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
