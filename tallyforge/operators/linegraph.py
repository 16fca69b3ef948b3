"""The line language ``unit A energy=80 -> B``: attributes, edges, colours, smoothing and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_after

# fixed values: thresholds and names of the energy colours, the step and the snap of smoothing
HOT, WARM, NEUTRAL = 80, 50, 0
STEP, SNAP = 0.1, 0.01
CURVE_POINTS = 20


def energy(text: Column | str) -> Column:
    """The integer after the first ``energy``: nothing there is -1, a bare minus 0."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract(text, r"energy[^0-9-]*(-?[0-9]*)", 1)
    return F.when(found == "", -1).when(found == "-", 0).otherwise(found.try_cast("int"))


def colour(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value >= HOT, "red").when(value >= WARM, "orange").when(value >= NEUTRAL, "green").otherwise("blue")


def analyse(lines: DataFrame, number: str = "line_no", text: str = "text") -> DataFrame:
    """unit, energy, colour, target_name, target_line and resolved_idx of each line.

    A target that starts with a digit is a line number and stays; a name goes to the first line of that unit,
    wherever it stands; -1 is no target.  Names are resolved by one aggregate and one join.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    raw = token_after(t, "->")
    first = F.substring(raw, 1, 1)
    own = lines.select(
        F.col(number).cast("long").alias("line_no"),
        F.col(text).alias("text"),
        token_after(t, "unit ").alias("unit"),
        energy(t).alias("energy"),
        colour(energy(t)).alias("colour"),
        F.when(first.rlike("[0-9]"), "").otherwise(raw).alias("target_name"),
        F.when(raw == "", -1).when(first.rlike("[0-9]"), F.regexp_extract(raw, "^([0-9]+)", 1).try_cast("int")).otherwise(-2).alias("target_line"),
    )
    units = own.filter("unit <> ''").groupBy(F.col("unit").alias("target_name")).agg(F.min("line_no").alias("__at"))
    joined = own.join(units, "target_name", "left")
    resolved = F.when(F.col("target_line") >= 0, F.col("target_line").cast("long")).when(F.col("target_line") == -2, F.coalesce("__at", F.lit(-1))).otherwise(F.lit(-1)).cast("long")
    return joined.select("line_no", "text", "unit", "energy", "colour", "target_name", "target_line", resolved.alias("resolved_idx"))


def with_target_energy(analysed: DataFrame) -> DataFrame:
    """Adds target_energy, that of the line at the other end of the edge."""
    ends = analysed.select(F.col("line_no").alias("resolved_idx"), F.col("energy").alias("target_energy"))
    return analysed.join(ends, "resolved_idx", "left")


def smoothed(current: Column, target: Column, ticks: int) -> Column:
    """The value after so many ticks: a tenth of the gap each, snapping where the gap is at most 0.01."""
    step = lambda x, _: F.when(F.abs(target - x) <= SNAP, target.cast("double")).otherwise(x + STEP * (target - x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ticks)), current.cast("double"), step) if ticks > 0 else current.cast("double")


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """The cubic Bernstein polynomial."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3


def curve(edges: DataFrame, p0: str, p1: str, p2: str, p3: str, points: int = CURVE_POINTS) -> DataFrame:
    """A row for each of the curve's points: step (from 0) and at."""
    steps = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("step"))
    return steps.withColumn("at", bezier(*(F.col(c).cast("double") for c in (p0, p1, p2, p3)), F.col("step") / F.lit(float(points))))
