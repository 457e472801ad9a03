"""Extractive compression: the units of a hit nearest to the question, within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what stands for units left out.
GAP = "[…]"


def select_units(units: DataFrame, hit: list[str], budget: int) -> DataFrame:
    """Units (hit..., idx from 0, unit, similarity) that are kept: the same rows less the others.

    By falling similarity (ties: earlier first) a unit is kept if it still fits; the first one always
    is. One that does not fit is passed over and the next one tried, so this is a fold over the hit's
    units, not a running sum. A heading at the very start stays and is free.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "idx", F.length("unit").alias("n"), (F.col("idx").eqNullSafe(F.lit(0)) & F.col("unit").startswith("#")).alias("head"))))
    state = "struct<used:int,any:boolean,kept:array<int>>"
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("any"), F.array().cast("array<int>").alias("kept")).cast(state)

    def step(s: Column, u: Column) -> Column:
        take = u["head"] | ~s["any"] | (s["used"] + u["n"] <= budget)
        return F.struct(
            F.when(take & ~u["head"], s["used"] + u["n"]).otherwise(s["used"]).alias("used"), (s["any"] | ~u["head"]).alias("any"),
            F.when(take, F.concat(s["kept"], F.array(u["idx"]))).otherwise(s["kept"]).alias("kept"),
        ).cast(state)

    kept = units.groupBy(*hit).agg(F.aggregate(ranked, start, step)["kept"].alias("k")).select(*hit, F.explode("k").alias("idx"))
    return units.join(kept, [*hit, "idx"])


def join_units(kept: DataFrame, counts: DataFrame, hit: list[str]) -> DataFrame:
    """``hit..., compact``: kept units in their order, a gap mark wherever others were left out; ``counts`` has hit..., n."""
    w = Window.partitionBy(*hit).orderBy("idx")
    marked = kept.withColumn("gap", F.col("idx") != F.coalesce(F.lag("idx").over(w), F.lit(-1)) + 1)
    lines = marked.withColumn("line", F.when(F.col("gap"), F.concat(F.lit(GAP + "\n"), F.col("unit"))).otherwise(F.col("unit")))
    joined = lines.groupBy(*hit).agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("l")).join(counts, hit)
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    last = F.element_at("l", -1)["idx"]
    return joined.select(*hit, F.when(last < F.col("n") - 1, F.concat(body, F.lit("\n" + GAP))).otherwise(body).alias("compact"))
