"""Column functions: arithmetic with the edge cases of volume data, and names of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(x: Column, y: Column, eps: float = 1e-10) -> Column:
    """x / y, or 0 where y is as good as zero."""
    return F.when(F.abs(y) > eps, x / y).otherwise(F.lit(0.0))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def nan_to(x: Column, value: float) -> Column:
    return F.nanvl(x, F.lit(value))


def rescale(x: Column, low: float, high: float) -> Column:
    """(x - low) / (high - low), with constants."""
    return (x - F.lit(low)) / F.lit(high - low)


def has_nonzero(values: Column) -> Column:
    return F.exists(values, lambda v: v != 0)


def first_number(name: Column) -> Column:
    """The first integer in a file's name, -1 if there is none."""
    return F.coalesce(F.regexp_extract(name, "[0-9]+", 0).try_cast("int"), F.lit(-1))


def float_list(text: Column) -> Column:
    """Numbers of a comma-separated list, with or without brackets."""
    return F.transform(F.split(F.translate(text, "[] ", ""), ","), lambda v: v.cast("double"))


def factor_name(x: Column) -> Column:
    """A factor with two decimals as folder names have it, e.g. 1p00."""
    return F.replace(F.format_string("%.2f", x), F.lit("."), F.lit("p"))


def role_of(name: Column, image_suffix: str = ".tif", label_suffix: str = ".npy") -> Column:
    """Whether a file is an image, a heat label or an integer label, by its name; null if it is none of them.

    All need a digit in the name. A label says "label" or "mask", an integer
    label "integer", an image none of these.
    """
    low = F.lower(name)
    digit = name.rlike("[0-9]")
    integer, label = low.contains("integer"), low.contains("label") | low.contains("mask")
    return (
        F.when(digit & integer, "integer")
        .when(digit & label & (low.endswith(label_suffix) | low.endswith(image_suffix)), "label")
        .when(digit & low.endswith(image_suffix), "image")
    )


def iou(n: Column, t_total: Column, p_total: Column) -> Column:
    return safe_divide(n.cast("double"), (t_total + p_total - n).cast("double"))


def iot(n: Column, t_total: Column, p_total: Column) -> Column:
    return safe_divide(n.cast("double"), t_total.cast("double"))


def iop(n: Column, t_total: Column, p_total: Column) -> Column:
    return safe_divide(n.cast("double"), p_total.cast("double"))


#: Scores of an overlap by name; add to it to offer another one.
CRITERIA: dict[str, Callable[[Column, Column, Column], Column]] = {"iou": iou, "iot": iot, "iop": iop}


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, tp / (tp + fn)).otherwise(F.lit(0.0))


def accuracy(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, tp / (tp + fp + fn)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def panoptic_quality(score_sum: Column, tp: Column, fp: Column, fn: Column) -> Column:
    return safe_divide(score_sum, tp + fp / 2 + fn / 2)


def squash(v: Column) -> Column:
    """The capsule non-linearity of an array: its direction, with length n / (1 + n) of its squared length n."""
    n = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    k = safe_divide(n / (1 + n), F.sqrt(n))
    return F.transform(v, lambda x: x.cast("double") * k)


def softmax(v: Column) -> Column:
    """Of an array, stabilised by its maximum."""
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double")))
    return F.transform(v, lambda x: F.exp((x - top).cast("double")) / total)


def entropy_bits(p: Column, eps: float = 1e-12) -> Column:
    """Of an array of probabilities, in bits."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x + eps))
