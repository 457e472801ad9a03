"""One ranking from several differently-scaled scores: robust rank aggregation.

Only ranks within the group count, so no scale can dominate. An item's normalised ranks r(1) <= ...
<= r(m) are held against the order statistics of m uniform ranks: P(Beta(k, m - k + 1) <= r(k)) is
the chance of a k-th best rank as good as this one. The least of the m probabilities, corrected by
the factor m, is the item's significance, and items rank by it (ties: mean rank, then key).

A null or NaN score counts as below all others (normalised rank 1). Equal scores share the greater
rank. Repeated rows of a group and key count once, with the latest one's scores. Rows without group
or key are left out; an empty table gives an empty result. Ranks are computed in blocks, so a group
may hold any share of the rows.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mneme.operators.ranking import group_rank
from mneme.storage import materialize


def beta_order_probability(r: Column, k: int, m: int) -> Column:
    """P(Beta(k, m - k + 1) <= r) as the binomial tail it equals."""
    total = None
    for j in range(k, m + 1):
        term = F.lit(float(comb(m, j))) * F.pow(r, F.lit(j)) * F.pow(F.lit(1.0) - r, F.lit(m - j))
        total = term if total is None else total + term
    return total


def significance(ranks: list[Column]) -> Column:
    """Corrected minimum of the order-statistic probabilities of normalised ``ranks``."""
    m = len(ranks)
    ordered = F.array_sort(F.array(*ranks))
    return F.least(
        F.lit(1.0),
        F.lit(float(m)) * F.least(*[beta_order_probability(ordered[k - 1], k, m) for k in range(1, m + 1)], F.lit(1.0)),
    )


def aggregate_ranks(scored: DataFrame, group: str, key: str, scores: list[str], latest: str | None = None) -> DataFrame:
    """``group, key, r_<score>..., rho, mean_rank`` for every item; smaller ``rho`` is better."""
    picked = scored.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    order = F.struct(*[F.col(c) for c in ([latest] if latest else [])], *[F.col(s) for s in scores])
    items = materialize(
        picked.groupBy(group, key).agg(F.max(order).alias("__s")).select(group, key, *[F.col(f"__s.{s}").alias(s) for s in scores]),
        "scores",
    )
    lists = [F.struct(F.lit(i).alias("list"), F.when(~F.isnan(s), F.col(s)).alias("score")) for i, s in enumerate(scores)]
    long = items.select(group, key, F.explode(F.array(*lists)).alias("x")).select(group, key, "x.list", "x.score")
    # all lists in one pass, back to their items in one join
    placed = long.join(group_rank(long, [group, "list"], "score"), [group, "list", "score"], "left")
    ranks = placed.groupBy(group, key).agg(*[F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"__rank{i}") for i in range(len(scores))])
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    normal = [F.coalesce(F.col(f"__rank{i}") / F.col("__size"), F.lit(1.0)) for i in range(len(scores))]
    return ranks.join(sizes, group).select(
        group, key, *[n.alias(f"r_{s}") for n, s in zip(normal, scores)],
        significance(normal).alias("rho"), (sum(normal[1:], normal[0]) / len(normal)).alias("mean_rank"),
    )


def best(aggregated: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The ``k`` most significant items of each group with their ``position``."""
    order = Window.partitionBy(group).orderBy("rho", "mean_rank", key)
    return aggregated.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
