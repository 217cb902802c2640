"""Quantile sketches of logarithmic bins: counts that add up, with a relative error.

A value falls into the bin ceil(log_g(|x|)), g = (1 + error) / (1 - error); the middle of a
bin is within `error` of all values in it. A sketch is a table of bins with counts, so
sketches are merged by adding counts, in any order and over any windows, and the partial
sums are made before the shuffle. The number of bins depends on the range of the values
alone: at an error of 0.01 a decade has 116.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.streaming.flows import stamped

ERROR = 0.01
#: Values nearer to zero count as zero.
LEAST = 1e-12


def bin_of(value: Column, error: float = ERROR) -> tuple[Column, Column]:
    """Side (-1, 0, 1) and bin of a value; both null for null and non-finite values."""
    x = value.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    size = F.abs(x)
    side = F.when(finite, F.when(size < LEAST, 0).otherwise(F.signum(x)).cast("int"))
    step = log((1 + error) / (1 - error))
    # Rounded so that the edge of a bin does not hang on the last digit of a logarithm.
    place = F.ceil(F.round(F.ln(size) / step, 9)).cast("int")
    return side, F.when(finite, F.when(size < LEAST, 0).otherwise(place))


def sketch(values: DataFrame, keys: list, column: str, error: float = ERROR) -> DataFrame:
    """Bins with counts for each group: the keys, `side, bin, n`. Null and non-finite values take no part."""
    side, place = bin_of(F.col(column), error)
    binned = values.withColumns({"side": side, "bin": place}).where(F.col("side").isNotNull())
    return binned.groupBy(*keys, "side", "bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list) -> DataFrame:
    """Sketches of smaller groups as those of larger ones."""
    return sketches.groupBy(*keys, "side", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], points: dict[str, float], error: float = ERROR) -> DataFrame:
    """Per group `n` and an estimate for each point: that of the value of rank floor(p * (n - 1)), from 0.

    The window holds the bins of a group, not its values.
    """
    growth = (1 + error) / (1 - error)
    upward = Window.partitionBy(*keys).orderBy(F.col("side"), F.col("side") * F.col("bin"))
    whole = Window.partitionBy(*keys)
    ranked = sketches.withColumns({
        "upto": F.sum("n").over(upward.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(whole),
        "middle": F.col("side") * 2 * F.pow(F.lit(growth), F.col("bin")) / (growth + 1),
    })
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("all") - 1)), F.col("middle")))
    return ranked.groupBy(*keys).agg(F.first("all").alias("n"), *[at(p).alias(name) for name, p in points.items()])


def window_sketches(requests: DataFrame, column: str, width: str, delay: str = "10 minutes", error: float = ERROR) -> DataFrame:
    """Sketch of a column per window and path over a stream (`ts, path`, the column).

    A busy path is spread over its bins; the state keeps counts of bins until the watermark
    has passed the window.
    """
    found = sketch(stamped(requests, "ts", delay), [F.window("ts", width).alias("w"), "path"], column, error)
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "path", "side", "bin", "n")
