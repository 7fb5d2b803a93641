"""Step and learning-rate schedules, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_steps(spark: SparkSession, n: int, last: int) -> DataFrame:
    """Steps 0, s, 2s, ... below last, where s is last/n rounded half to even, at least 1."""
    step = max(1, round(last / n))
    return spark.range(0, last, step).select(F.col("id").alias("step"))


def log_steps(spark: SparkSession, n: int, last: int) -> DataFrame:
    """The distinct rounded (half to even) terms of a geometric series of n terms from 1 to below last."""
    x = F.bround(F.pow(F.lit(float(last)), F.col("id") / F.lit(float(n)))).cast("bigint")
    return spark.range(n).select(x.alias("step")).distinct()


def warmup_steps(total: int, *, ratio: float | None = 0.0, steps: int | None = None) -> int:
    """Warm-up of the trainer: a ratio, where given, is held within 5 and 20 steps and outweighs steps."""
    if ratio is not None:
        return min(max(5, int(ratio * total)), 20)
    return 5 if steps is None else steps


def warmup_steps_alone(total: int, *, ratio: float | None = None, steps: int | None = None) -> int:
    """Warm-up of the schedule used by itself: at least 3 steps."""
    if steps is None:
        steps = int((ratio or 0) * total)
    return int(max(steps, 3))


def cosine_multiplier(step: Column, total: int, warmup: int, floor: float = 0.0) -> Column:
    """Learning-rate multiplier: a linear rise over the warm-up, then half a cosine down to floor."""
    x = step.cast("double")
    rise = F.lit(floor) + F.lit(1 - floor) * F.least(x, F.lit(float(warmup))) / F.lit(float(warmup))
    done = F.greatest(F.lit(0.0), x - F.lit(float(warmup))) / F.lit(float(total - warmup))
    fall = F.lit(floor) + F.lit(0.5) * F.lit(1 - floor) * (F.lit(1.0) + F.cos(done * F.pi()))
    return F.least(rise, fall)


def lr_schedule(spark: SparkSession, total: int, warmup: int, floor: float = 0.0) -> DataFrame:
    """(step, multiplier) for every step below total."""
    return spark.range(total).select(F.col("id").alias("step"), cosine_multiplier(F.col("id"), total, warmup, floor).alias("multiplier"))
