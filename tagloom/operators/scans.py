"""Running values and running numbers over ordered rows, without a window that holds all of them.

Rows are cut into chunks; a chunk is summed up in one row, those few rows are scanned by a window, and what
lies before a chunk is joined to the running values inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 4096
_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(F.coalesce(a, b), F.coalesce(b, a))),
    "max": (F.max, lambda a, b: F.greatest(F.coalesce(a, b), F.coalesce(b, a))),
}


def scan(rows: DataFrame, by: list[str], order: str, of: dict[str, tuple[str, Column]], before: bool = False, chunk: int = CHUNK, few: bool = False) -> DataFrame:
    """``rows`` with a running value for each name of ``of`` in each group of ``by``: its kind (sum, min, max) and what of each row goes in.

    ``order`` is a whole number, different in each row of a group and not much larger than the group's
    rows are many. A value covers the row itself unless ``before``; then the first row's sum is 0 and its
    min and max are null. A row of the last window stands for ``chunk`` rows. ``few``: the caller knows that
    a group is no larger than a chunk, so one window does.
    """
    if few:
        frame = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
        return rows.withColumns({n: F.coalesce(_KINDS[k][0](c).over(frame), F.lit(0) if k == "sum" else F.lit(None)) for n, (k, c) in of.items()})
    inside = W.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    cut = rows.withColumn("__chunk", F.floor(F.col(order) / chunk)).withColumns({f"__v_{n}": c for n, (_, c) in of.items()})
    ran = cut.withColumns({f"__in_{n}": _KINDS[k][0](f"__v_{n}").over(inside) for n, (k, _) in of.items()})
    sums = cut.groupBy(*by, "__chunk").agg(*[_KINDS[k][0](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in of.items()])
    earlier = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    past = sums.select(*by, "__chunk", *[_KINDS[k][0](f"__t_{n}").over(earlier).alias(f"__b_{n}") for n, (k, _) in of.items()])
    whole = _joined(ran, past, [*by, "__chunk"]).withColumns({n: _KINDS[k][1](F.col(f"__b_{n}"), F.col(f"__in_{n}")) for n, (k, _) in of.items()})
    return whole.drop("__chunk", *[f"__{p}_{n}" for n in of for p in ("v", "in", "b")])


def _joined(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``few``, nulls of the keys equal."""
    other = few.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__on_{c}"))
        same = one if same is None else same & one
    return rows.join(other, same).drop(*[f"__on_{c}" for c in on])


def numbered(rows: DataFrame, by: list[str], part: Column, order: list, name: str) -> DataFrame:
    """``rows`` with a number from 0 in each group of ``by``, by (part, order): ranked inside parts, parts' sizes added.

    ``part`` must not decrease along the order that is meant (a prefix of a hash, a range of ids); a
    group is then shared by as many tasks as it has parts.
    """
    cut = rows.withColumn("__part", part)
    sizes = cut.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    past = sizes.withColumn("__past", F.sum("__n").over(W.partitionBy(*by).orderBy("__part")) - F.col("__n")).drop("__n")
    ranked = cut.withColumn("__at", F.row_number().over(W.partitionBy(*by, "__part").orderBy(*order)) - 1)
    joined = _joined(ranked, past, [*by, "__part"])
    return joined.withColumn(name, (F.col("__past") + F.col("__at")).cast("bigint")).drop("__at", "__past", "__part")
