"""Exact quantiles of many groups at once, by radix selection.

Values are never sorted as a whole. A pass counts them by slot, where slots follow the order of
the values: first by sign, exponent and leading bits, later by place between the least and the
greatest value of the slot that is opened. Running sums over the counts of a group tell which slots
hold the wanted ranks; only those are opened in the next pass, for all groups together. A slot
whose values are all equal is settled, one with few values is gathered and sorted. Four passes tell
any two doubles apart; ordinary columns need two.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import nulls
from tablewright.staging import held

#: A slot with at most so many rows is gathered and sorted.
GATHERED = 4096
#: Slots into which an opened slot is divided.
SLOTS = 65_536

_STEPS_PER_DOUBLING, _MIDDLE, _BEYOND = 32, 50_000, 2_000


def _slot_of(value: Column) -> Column:
    """Sign, exponent and leading bits as a number that does not fall where the value rises."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(float(_BEYOND))) * F.lit(_STEPS_PER_DOUBLING)) + F.lit(_MIDDLE)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("int")


def _places(total: Column, probabilities: Sequence[float]) -> list[Column]:
    return [(total - 1) * F.lit(float(p)) for p in probabilities]


def _wanted(counts: DataFrame, group: list[str], parent: list[str], probabilities: Sequence[float]) -> DataFrame:
    """Of counted slots those that hold a wanted rank: how many rows of the group lie before them, and in all."""
    siblings = Window.partitionBy(*[nulls.col(g) for g in [*group, *parent]])
    before = F.coalesce(F.sum("__n").over(siblings.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if parent:
        start, total = F.col("__start") + before, F.col("__total")
    else:
        start, total = before, F.sum("__n").over(siblings)
    slots = counts.select(*[nulls.col(g) for g in group], start.alias("__start"), total.alias("__total"), "__n", "__low", "__high")
    hit = F.lit(False)
    for place in _places(F.col("__total"), probabilities):
        for rank in (F.floor(place), F.ceil(place)):
            hit = hit | ((F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__n")))
    return slots.filter(hit)


def _opened(long: DataFrame, slots: DataFrame, group: list[str]) -> DataFrame:
    """The rows of opened slots, with the columns of their slot."""
    return long.join(slots, group).filter((F.col("__value") >= F.col("__low")) & (F.col("__value") <= F.col("__high")))


def quantiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[Column], probabilities: Sequence[float], gathered: int = GATHERED,
) -> DataFrame:
    """Interpolated quantiles per group: keys, number of the value `metric`, one `q{i}` per probability.

    Runs a pass for each level of slots now. Missing values and NaN don't count; groups without a value
    and those with a missing key do not appear.
    """
    lanes = [p for i, c in enumerate(values) for p in (F.lit(i), c.cast("double") + F.lit(0.0))]
    long = df.select(*[nulls.col(k) for k in keys], F.stack(F.lit(len(values)), *lanes).alias("metric", "__value"))
    long = long.filter(F.col("__value").isNotNull() & ~F.isnan("__value"))
    for k in keys:
        long = long.filter(nulls.col(k).isNotNull())
    group = [*keys, "metric"]
    count = [F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__low"), F.max("__value").alias("__high")]
    columns = [nulls.col(g) for g in group]
    counts = long.groupBy(*columns, _slot_of(F.col("__value")).alias("__slot")).agg(*count)
    slots = _wanted(counts, group, [], probabilities)
    parts = []
    picked = lambda f: [f(rank).alias(f"{side}{i}") for i, place in enumerate(_places(F.col("__total"), probabilities))
                        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place)))]
    inside = lambda rank: (F.col("__start") <= rank) & (rank < F.col("__start") + F.col("__n"))
    while True:
        opened, rows = held(slots, "slots")
        if rows is None:
            sizes = [n for n in opened.filter("__low < __high").agg(F.min("__n"), F.max("__n")).first() if n is not None]
        else:
            sizes = pc.filter(rows["__n"], pc.less(rows["__low"], rows["__high"])).to_pylist()
        parts.append(opened.filter("__low = __high").select(*columns, "__total", *picked(lambda r: F.when(inside(r), F.col("__low")))))
        if any(n <= gathered for n in sizes):
            few = opened.filter(f"__low < __high AND __n <= {int(gathered)}")
            lists = _opened(long, few, group).groupBy(*columns, "__start", "__total", "__n").agg(F.sort_array(F.collect_list("__value")).alias("__list"))
            parts.append(lists.select(
                *columns, "__total", *picked(lambda r: F.when(inside(r), F.get("__list", (r - F.col("__start")).cast("int"))))))
        if all(n <= gathered for n in sizes):
            break
        many = opened.filter(f"__low < __high AND __n > {int(gathered)}").drop("__n")
        between = (F.col("__value") - F.col("__low")) / (F.col("__high") - F.col("__low"))
        inner = _opened(long, many, group).withColumn("__slot", F.floor(between * F.lit(SLOTS - 1)).cast("int"))
        counts = inner.groupBy(*columns, "__start", "__total", "__slot").agg(*count)
        slots = _wanted(counts, group, ["__start"], probabilities)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    ends = [f"{side}{i}" for i in range(len(probabilities)) for side in ("low", "high")]
    found = union.groupBy(*columns).agg(F.max("__total").alias("__total"), *[F.max(e).alias(e) for e in ends])
    steps = _places(F.col("__total"), probabilities)
    return found.select(*columns, *[
        F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}"))
        .otherwise(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (s - F.floor(s))).alias(f"q{i}")
        for i, s in enumerate(steps)])
