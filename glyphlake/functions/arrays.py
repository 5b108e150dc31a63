"""Running values inside an array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F


def bound(value, function) -> F.Column:
    """function(value), with value made once: expressions of arrays are not shared where they are used more than once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def before(values, zero, join) -> F.Column:
    """For each value what join makes of zero and those before it (longs).

    In two levels of about the square root of the length, as an array that grows is copied at each step.
    """

    def run(part, start):
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, first, lambda a, v: F.struct(join(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def of(v):
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.slice(v, k * width + 1, width))
        sums = lambda p: F.zip_with(p, run(F.transform(p, lambda part: F.aggregate(part, zero, join)), zero), run)
        return F.when(F.size(v) > 0, F.flatten(bound(parts, sums))).otherwise(F.array().cast("array<bigint>"))

    return bound(values, of)
