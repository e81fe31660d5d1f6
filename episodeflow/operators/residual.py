"""Residuals of a signal: second-difference signs, windowed quantisation, bit packing.

All arithmetic is in double precision. Steps are ordered by ``order`` within an
episode (and any further partition columns); a window function shuffles once by
episode, and chained ones reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_of_peak(before: Column, now: Column, after: Column) -> Column:
    """+1 at a peak, -1 at a trough, 0 on a line, for NaN and at the edges."""
    d = 2 * now.cast("double") - before.cast("double") - after.cast("double")
    return F.when(before.isNull() | after.isNull() | F.isnan(d), 0).when(d > 0, 1).when(d < 0, -1).otherwise(0)


def sign2nd_diff(steps: DataFrame, value: str, by: tuple[str, ...] = ("episode_id",), order: str = "t", out: str = "residual", block: int | None = None) -> DataFrame:
    """Add the sign of the negated second difference; 0 at the first and last step.

    With ``block``, an episode is dealt out in blocks of so many steps, so one that
    holds a large share of all rows is many tasks' work. Its steps must then be
    numbered without gaps; the steps at a block's ends go to its neighbours too.
    """
    x = F.col(value)
    if block is None:
        w = Window.partitionBy(*by).orderBy(order)
        return steps.withColumn(out, sign_of_peak(F.lag(x).over(w), x, F.lead(x).over(w)))
    own, place = F.floor(F.col(order) / block).cast("bigint"), F.col(order) % block
    to = F.array_compact(F.array(own, F.when((place == 0) & (own > 0), own - 1), F.when(place == block - 1, own + 1)))
    w = Window.partitionBy(*by, "_block").orderBy(order)
    dealt = steps.withColumn("_block", F.explode(to))
    signs = dealt.withColumn(out, sign_of_peak(F.lag(x).over(w), x, F.lead(x).over(w)))
    return signs.where(F.col("_block") == own).drop("_block")


def sign2nd_diff_vector(steps: DataFrame, value: str, by: tuple[str, ...] = ("episode_id",), order: str = "t", out: str = "residual") -> DataFrame:
    """The same for each dimension of an array column, without exploding it."""
    w = Window.partitionBy(*by).orderBy(order)
    x = F.col(value)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    inner = F.transform(x, lambda v, i: sign_of_peak(F.get(F.col("_before"), i), v, F.get(F.col("_after"), i)))
    return steps.withColumns({"_before": before, "_after": after}).withColumn(out, inner).drop("_before", "_after")


def error_residual(steps: DataFrame, signal: str, omen: str, **kw) -> DataFrame:
    """The residual of a signal's deviation from its prediction."""
    return sign2nd_diff(steps.withColumn("_error", F.col(signal).cast("double") - F.col(omen).cast("double")), "_error", **kw).drop("_error")


def quantise(steps: DataFrame, signal: str, omen: str, window: int = 256, half_away: bool = False, by: tuple[str, ...] = ("episode_id",), order: str = "t") -> DataFrame:
    """Add win, scale and q: deviations in units of a 127th of their window's largest.

    Rounding is to even, or away from zero with ``half_away``. A window without
    deviation has scale 1.
    """
    delta = F.col(signal).cast("double") - F.col(omen).cast("double")
    steps = steps.withColumn("win", F.floor(F.col(order) / window).cast("bigint")).withColumn("_delta", delta)
    most = F.max(F.abs("_delta")).over(Window.partitionBy(*by, "win"))
    steps = steps.withColumn("scale", F.when(most == 0, 1.0).otherwise(most / 127.0))
    ratio = F.col("_delta") / F.col("scale")
    q = F.round(ratio) if half_away else F.rint(ratio)
    return steps.withColumn("q", F.greatest(F.lit(-127.0), F.least(F.lit(127.0), q)).cast("int")).drop("_delta")


def window_scales(steps: DataFrame, signal: str, omen: str, window: int = 256, by: tuple[str, ...] = ("episode_id",), order: str = "t") -> DataFrame:
    """One row for each window with its largest deviation."""
    win = F.floor(F.col(order) / window).cast("bigint").alias("win")
    return steps.groupBy(*by, win).agg(F.max(F.abs(F.col(signal).cast("double") - F.col(omen).cast("double"))).alias("max_abs"))


def reconstruct(quantised: DataFrame, omen: str, out: str = "reconstructed") -> DataFrame:
    """The prediction plus the dequantised deviation."""
    return quantised.withColumn(out, F.col(omen).cast("double") + F.col("q") * F.col("scale"))


def pack_bits(steps: DataFrame, sign: str, by: tuple[str, ...] = ("episode_id",), order: str = "t", out: str = "packed") -> DataFrame:
    """Pack signs into bytes, lowest bit first: 1 where the sign is positive.

    Bytes are summed before they meet, so an episode's group holds an eighth of
    its steps.
    """
    byte = F.floor(F.col(order) / 8).cast("bigint").alias("byte")
    bit = F.when(F.col(sign) > 0, F.expr(f"shiftleft(1, int({order} % 8))")).otherwise(0)
    bytes_ = steps.groupBy(*by, byte).agg(F.sum(bit).alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("byte", "v")))
    hexed = F.array_join(F.transform(ordered, lambda b: F.lpad(F.hex(b["v"]), 2, "0")), "")
    return bytes_.groupBy(*by).agg(F.unhex(hexed).alias(out))


def unpack_bits(packed: DataFrame, length: str, packed_col: str = "packed", edge_zero: bool = False, out: str = "sign") -> DataFrame:
    """One row for each step: +1 for a set bit, -1 for another; zeros don't come back.

    With ``edge_zero``, the first and last step are 0.
    """
    rows = packed.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1))).where(F.col(length) > 0)
    bit = F.expr(f"getbit(cast(conv(hex(substring({packed_col}, int(t div 8) + 1, 1)), 16, 10) as bigint), int(t % 8))")
    sign = F.when(bit == 1, 1).otherwise(-1)
    if edge_zero:
        sign = F.when((F.col("t") == 0) | (F.col("t") == F.col(length) - 1), 0).otherwise(sign)
    return rows.withColumn(out, sign)


def dequantise_rows(values: DataFrame, value: str, scales: str, row: str, lenient: bool = False) -> DataFrame:
    """Multiply int8 values by their row's scale; one scale serves all rows.

    With ``lenient``, a number of scales that isn't that of the rows means that
    the first serves all.
    """
    n = F.size(scales)
    own = F.get(F.col(scales), F.col(row).cast("int"))
    scale = F.when(n == 1, F.get(F.col(scales), F.lit(0))).otherwise(own)
    if lenient:
        scale = F.when(F.col("rows") != n, F.get(F.col(scales), F.lit(0))).otherwise(scale)
    return values.withColumn("dequantised", F.col(value).cast("double") * scale)
