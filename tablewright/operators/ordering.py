"""Running sums, row numbers and offsets over an order that spans the whole table.

A window without partitions, or with one huge partition, puts its rows into one task.
Here the order is cut into ranges first:

1. a small random sample of the order columns, written to the shared folder, gives the cut
   points (the sample only places the cuts, every row is kept);
2. a row finds its range by binary search: among all cuts where these are few, else first
   among coarse cuts (about the square root of their number) and then among the cuts of its
   coarse part, which a broadcast brings along. Where the cuts are too large for that, each
   part's rows and cuts are sorted together and the cuts before a row are counted, so that no
   row and no task holds the cuts of a part. A cut keeps no more of a text than tells it from
   the key before it. The keys stay in Spark; the driver sees how many there are. A row's range
   is a pure function of its own values, so a lost task computes the same one again;
3. sums per range, and per group where a group crosses a cut, are at most two rows per cut.
   What came before each is summed up a tree, so that no task sees more than FAN of them at once;
4. one shuffle sends each range to one task, which sorts it and adds the offset; where ranges
   are many and short, neighbours share a task. Coarse parts that were dealt out to be sorted
   with their cuts stay where they are, unless they are too large for a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import nulls
from tablewright.staging import stage

ROWS_PER_RANGE = 500_000
SAMPLES_PER_RANGE = 32
#: So many cuts are searched at once, and so many sums of ranges added up in one task.
FAN = 256
#: Tables of cuts and of offsets are broadcast up to these sizes, beyond them shuffled.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 50_000
#: Rows of one coarse part that a task sorts with its cuts.
ROWS_PER_SALT = 2_000_000
#: So many characters of a text a cut keeps, the first that tell it from the key before it.
STARTS = (16, 64, 512, 4096)

_RANGE, _KEY, _COPIES, _PART, _CUTS, _BASE, _SALT = "__range", "__key", "__copies", "__part", "__cuts", "__base", "__salt"
_TASK, _HASH, _CUT = "__task", "__hash", "__cut"


@dataclass(frozen=True)
class Ranged:
    """A table whose rows carry the number of their range."""

    frame: DataFrame
    count: int
    rows: int
    cuts: DataFrame | None
    partition: tuple[str, ...]
    order: tuple[Column, ...]

    def shuffled(self) -> DataFrame:
        """Neighbouring ranges share a task where they are many and short: a task costs more than a few rows."""
        if _TASK in self.frame.columns:
            return self.frame
        spark = self.frame.sparkSession
        tasks = max(math.ceil(self.rows / ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
        each = math.ceil(self.count / min(self.count, tasks))
        frame = self.frame.withColumn(_TASK, F.floor(nulls.col(_RANGE) / F.lit(each)).cast("int"))
        return frame.repartitionById(math.ceil(self.count / each), nulls.col(_TASK))

    def keys(self) -> list[Column]:
        return [nulls.col(_TASK), nulls.col(_RANGE), *[nulls.col(p) for p in self.partition]]

    def window(self):
        return Window.partitionBy(*self.keys()).orderBy(*self.order)


def _key_struct(columns: Sequence[tuple[str, Column]]) -> Column:
    """Comparable tuple in which a missing part sorts after every value."""
    parts = []
    for i, (_, c) in enumerate(columns):
        parts += [F.nullif(c.isNull().cast("int"), F.lit(2)).alias(f"n{i}"), c.alias(f"v{i}")]
    return F.struct(*parts)


def _hash_of_rest(df: DataFrame, used: set[str]) -> list[tuple[str, Column]]:
    """One number from all other columns, so that only equal rows stay tied."""
    rest = [f.name for f in df.schema if f.name not in used and nulls.is_scalar(f.dataType)]
    if not rest:
        return []
    # NULL would leave the hash unchanged, so every value brings its presence along.
    parts = [p for n in rest for p in (nulls.col(n).isNull(), nulls.col(n))]
    return [("", F.xxhash64(*parts))]


def _short(key: T.StructType, last: str) -> Column:
    """A key that sorts after the one before it and not after its own, with the start of the text that tells them apart."""
    parts, same = [], F.lit(True)
    for f in key.fields:
        now, was = F.col(f"{_KEY}.{f.name}"), F.col(f"{last}.{f.name}")
        value = now
        if f.dataType == T.StringType():
            for k in reversed(STARTS):
                start = F.substring(now, 1, k)
                value = F.when(start > was, start).otherwise(value)
            # Where a column further up differs, any text up to its own will do.
            value = F.when(same, value).otherwise(F.when(now.isNotNull(), F.lit("")))
        parts.append(value.alias(f.name))
        same = same & now.eqNullSafe(was)
    return F.when(F.col(last).isNull(), F.col(_KEY)).otherwise(F.struct(*parts))


def _hits(sample: DataFrame, part: str, step: int) -> DataFrame:
    """part, shortened key and `hit` of each key: how many of the places step, 2 * step, ... of its part it takes.

    Equal keys are counted first, so that a frequent one is a single row in its part.
    """
    in_order = Window.partitionBy(part).orderBy(_KEY)
    up_to = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = sample.groupBy(part, _KEY).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.select("*", up_to.alias("end"), F.lag(_KEY).over(in_order).alias("last"))
    # Keys stand at places 0, 1, ...; the cuts are the places step, 2 * step, ...
    hit = F.floor((F.col("end") - 1) / F.lit(step)) - F.floor(F.greatest(F.col("end") - F.col("n") - 1, F.lit(0)) / F.lit(step))
    key = sample.schema[_KEY].dataType
    short = _short(key, "last") if isinstance(key, T.StructType) else F.col(_KEY)
    return counted.select(part, short.alias(_KEY), hit.alias("hit"))


def _every(sample: DataFrame, part: str, step: int) -> DataFrame:
    """part, `__cuts` and `__all`: every step-th key of each part in order, equal ones once, and how many with repeats."""
    return _hits(sample, part, step).groupBy(part).agg(
        F.sort_array(F.collect_list(F.when(F.col("hit") > 0, nulls.col(_KEY)))).alias(_CUTS), F.sum("hit").alias("__all"))


def _found(frame: DataFrame, cuts: Column, output: str, most: int) -> DataFrame:
    """Binary search, one projection per halving: the number of cuts (at most `most`) not above the key."""
    frame = frame.withColumn(output, F.lit(0))
    step = 1 << max(0, most.bit_length() - 1)
    while step and most:
        reached = F.get(cuts, nulls.col(output) + F.lit(step - 1)) <= nulls.col(_KEY)
        frame = frame.withColumn(output, nulls.col(output) + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return frame


@dataclass(frozen=True)
class _Tree:
    """Cuts in order, in two levels where there are many: coarse ones, and the cuts of each coarse part."""

    top: DataFrame
    tops: int
    cuts: DataFrame | None
    parts: DataFrame | None
    most: int
    size: int
    heavy: bool
    count: int

    def keys(self) -> DataFrame:
        """All cuts, a row each."""
        top = self.top.select(F.explode(_CUTS).alias(_KEY))
        return top if self.cuts is None else top.unionByName(self.cuts.select(_KEY))

    def place(self, df: DataFrame, columns: Sequence[tuple[str, Column]], rows: int) -> DataFrame:
        """The table with the number of each row's range, and with the task of rows that were dealt out for it."""
        frame = df.withColumn(_KEY, _key_struct(columns)).withColumn(_CUTS, self.top.select(_CUTS).scalar())
        if self.cuts is None:
            return _found(frame, nulls.col(_CUTS), _RANGE, self.tops).drop(_KEY, _CUTS)
        frame = _found(frame, nulls.col(_CUTS), _PART, self.tops).drop(_CUTS)
        if self.size > BROADCAST_BYTES:
            return self._sorted(frame, df.columns, columns, rows)
        cuts = self.cuts.groupBy(_PART).agg(F.sort_array(F.collect_list(_KEY)).alias(_CUTS))
        parts = F.broadcast(stage(self.parts.select(_PART, _BASE).join(cuts, _PART, "left"), "cuts"))
        frame = _found(frame.join(parts, _PART), nulls.col(_CUTS), "__place", self.most)
        frame = frame.withColumn(_RANGE, nulls.col(_BASE) + nulls.col("__place"))
        return frame.select(*[nulls.col(c) for c in df.columns], nulls.col(_RANGE))

    def _sorted(self, frame: DataFrame, names: Sequence[str], columns: Sequence[tuple[str, Column]], rows: int) -> DataFrame:
        """The same by sorting rows and cuts of a part together; a cut stands before the rows that are equal to it."""
        salts = max(1, math.ceil(rows / (self.tops + 1) / ROWS_PER_SALT))
        frame = frame.withColumns({_HASH: c for n, c in columns if not n})
        frame = frame.withColumns({_SALT: F.pmod(F.xxhash64(_KEY), F.lit(salts)).cast("int"), _CUT: F.lit(None).cast("int")}).drop(_KEY)
        order = {n or _HASH: F.col(f"{_KEY}.v{i}") for i, (n, _) in enumerate(columns)}
        own = {_PART: nulls.col(_PART), _SALT: nulls.col(_SALT), _CUT: F.lit(1)}
        cuts = self.cuts.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
            *[(order | own).get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in frame.schema])
        # The salt is known to be 0 where there is one, so that the rows are dealt by their part alone.
        on = [_PART, _SALT] if salts > 1 else [_PART]
        w = Window.partitionBy(*on).orderBy(*[nulls.col(n).asc_nulls_last() for n in order], nulls.col(_CUT).asc_nulls_last())
        earlier = F.count(_CUT).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        frame = frame.unionByName(cuts).withColumn("__place", earlier).filter(nulls.col(_CUT).isNull())
        frame = frame.join(_some(self.parts.select(_PART, _BASE), self.tops + 1), _PART)
        frame = frame.withColumn(_RANGE, (nulls.col(_BASE) + nulls.col("__place")).cast("int"))
        task = [nulls.col(_PART).alias(_TASK)] if salts == 1 and rows / (self.tops + 1) <= ROWS_PER_RANGE else []
        return frame.select(*[nulls.col(n) for n in names], nulls.col(_RANGE), *task)


def _tree(df: DataFrame, key: Column, rows: int, ranges: int) -> _Tree:
    """Cuts between `ranges` ranges of about equal size, from a sample of the keys."""
    spark = df.sparkSession
    fraction = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    sample = df.select(key.alias(_KEY)).sample(fraction, seed=7)
    every = max(1, round(rows * fraction / ranges))
    parts = 1 if ranges <= FAN else math.isqrt(ranges)
    share = 1.0 if ranges <= FAN else parts / ranges
    picked, step = (sample, every) if parts == 1 else (sample.sample(share, seed=11), max(1, round(every * ranges * share / parts)))
    # Even without a row in the sample there is one part.
    first_part = spark.range(1).select(F.lit(0).alias(_PART))
    top = first_part.join(_every(picked.withColumn(_PART, F.lit(0)), _PART, step), _PART, "left")
    top = stage(top.select(_CUTS, F.coalesce("__all", F.lit(0)).alias("__all")), "cuts")
    n, hits = top.select(F.greatest(F.size(_CUTS), F.lit(0)), "__all").first()
    if parts == 1:
        return _Tree(top, n, None, None, n, 0, hits > n, n + 1)
    sample = _found(sample.withColumn(_CUTS, top.select(_CUTS).scalar()), nulls.col(_CUTS), _PART, n).select(_PART, _KEY)
    if hits == n:
        # No key is so frequent that it had to be counted before it is sent to its part.
        sample = sample.repartition(nulls.col(_PART))
    cuts = stage(_hits(sample, _PART, every).filter("hit > 0"), "cuts")
    sizes = cuts.groupBy(_PART).agg(
        F.count(F.lit(1)).alias("known"), F.sum("hit").alias("__all"), F.sum(F.length(F.to_json(_KEY)) + 1).alias("size"))
    # A part that the sample missed has no cuts of its own.
    sizes = spark.range(n + 1).select(F.col("id").cast("int").alias(_PART)).join(sizes, _PART, "left").na.fill(0)
    # The number of ranges before each part; a row per coarse cut.
    earlier = Window.partitionBy(F.floor(F.col(_PART) / F.lit(1 << 30))).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn(_BASE, F.coalesce(F.sum(F.col("known") + 1).over(earlier), F.lit(0)).cast("int")), "cuts")
    total, most, lost, size = sizes.agg(F.sum("known"), F.max("known"), F.sum(F.col("__all") - F.col("known")), F.sum("size")).first()
    return _Tree(top, n, cuts.select(_PART, _KEY), sizes, most, size, bool(lost), total + n + 1)


def ranged(
    df: DataFrame,
    order: Sequence[str],
    partition: Sequence[str] = (),
    tie: Sequence[str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    cut_by_hash: bool = False,
) -> tuple[Ranged, bool]:
    """Cut the table into ranges of (partition, order, tie), or also of a hash of the rest.

    Cutting by few columns lets the sample and the sums read few columns. The second value
    tells whether rows that are equal in the cutting columns would fill a range.
    """
    named = [(n, nulls.col(n)) for n in dict.fromkeys([*partition, *order, *(tie or ())])]
    rest = _hash_of_rest(df, {n for n, _ in named}) if tie is None or cut_by_hash else []
    columns = named + rest if cut_by_hash else named
    key = _key_struct(columns)
    sort = tuple(c.asc_nulls_last() for _, c in (named + rest)[len(partition):])
    rows = df.count()
    ranges = max(1, math.ceil(rows / rows_per_range))
    if ranges == 1:
        single = df.withColumn(_RANGE, F.lit(0))
        return Ranged(single, 1, rows, None, tuple(partition), sort), False
    tree = _tree(df, key, rows, ranges)
    return Ranged(tree.place(df, columns, rows), tree.count, rows, tree.keys(), tuple(partition), sort), tree.heavy


def _some(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast where a count has shown that it is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _crossing_groups(r: Ranged) -> DataFrame:
    """Groups that a cut falls into: at most one per cut."""
    names = [F.col(f"{_KEY}.v{i}").alias(p) for i, p in enumerate(r.partition)]
    return r.cuts.select(*names).distinct()


def before(
    table: DataFrame, keys: Sequence[str], index: str, names: Sequence[str], count: int,
    over: Callable[[Column], Column], fold: Callable[[Column, Column], Column], both: Callable[[Column, Column], Column],
) -> DataFrame:
    """keys, index, `__before_<name>`: values of earlier rows of a group, put together up a tree.

    `index` counts from 0 to `count` - 1. FAN neighbours share a parent; a row takes what its
    earlier siblings hold (`over` a window) and what came before its parent (`both` of the two),
    and a parent holds the `fold` of its children.
    """
    group = [nulls.col(k) for k in keys]
    parent = F.floor(nulls.col(index) / F.lit(FAN)).cast("bigint")
    earlier = Window.partitionBy(*group, parent).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    out = table.select(*group, index, *[over(nulls.col(n)).over(earlier).alias(f"__before_{n}") for n in names])
    if count <= FAN:
        return out
    up = f"{index}_up"
    parents = table.groupBy(*group, parent.alias(up)).agg(*[fold(nulls.col(n), nulls.col(index)).alias(n) for n in names])
    above = before(parents, keys, up, names, math.ceil(count / FAN), over, fold, both)
    above = above.withColumnsRenamed({f"__before_{n}": f"__above_{n}" for n in names})
    out = out.withColumn(up, parent).join(above, [up, *keys], "left")
    return out.select(
        *group, index, *[both(nulls.col(f"__before_{n}"), nulls.col(f"__above_{n}")).alias(f"__before_{n}") for n in names])


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _offsets(r: Ranged, sums: Mapping[str, Column], totals: bool) -> DataFrame:
    """What came before each range, and the group total, for groups that cross a cut."""
    keys = [nulls.col(_RANGE), *[nulls.col(p) for p in r.partition]]
    frame = r.frame
    if r.partition:
        frame = frame.join(_some(_crossing_groups(r), r.count), list(r.partition), "left_semi")
    per_range = frame.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    out = before(per_range, r.partition, _RANGE, list(sums), r.count, F.sum, lambda c, _: F.sum(c), _added)
    if totals:
        group = Window.partitionBy(*[nulls.col(p) for p in r.partition])
        everything = per_range.select(*keys, *[F.sum(nulls.col(n)).over(group).alias(f"__all_{n}") for n in sums])
        out = out.join(everything, [_RANGE, *r.partition])
    return out


def _with_prefix(r: Ranged, sums: Mapping[str, Column], totals: bool) -> DataFrame:
    running = r.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*r.keys())
    out = r.shuffled().select(
        "*",
        *[F.sum(c).over(running).alias(n) for n, c in sums.items()],
        *([F.sum(c).over(everything).alias(f"{n}_total") for n, c in sums.items()] if totals else []),
    )
    out = out.drop(_TASK)
    if r.cuts is None:
        return out.drop(_RANGE)
    names = out.columns
    out = out.join(_some(_offsets(r, sums, totals), 2 * r.count), [_RANGE, *r.partition], "left")
    final = []
    for n in names:
        if n == _RANGE:
            continue
        c = nulls.col(n)
        if n in sums:
            # A running sum without a value yet is NULL and takes over what came before.
            c = _added(c, nulls.col(f"__before_{n}"))
        elif totals and n.endswith("_total") and n[: -len("_total")] in sums:
            c = F.coalesce(nulls.col(f"__all_{n[: -len('_total')]}"), c)
        final.append(c.alias(n))
    return out.select(*final)


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    partition: Sequence[str] = (),
    tie: Sequence[str] | None = None,
    totals: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Running sums in the given order within each partition, no matter how large it is.

    `tie` orders rows with equal order columns; by default a hash of all other columns
    does. `totals` adds `<name>_total`, the sum over the whole partition. Rows whose
    partition is NULL come out with sums of their own range only; callers drop them.
    """
    return _prefix_sums(df, order, sums, partition, tie, totals, rows_per_range)[0]


def _prefix_sums(df, order, sums, partition, tie, totals, rows_per_range) -> tuple[DataFrame, int]:
    """The result and the number of its rows."""
    r, heavy = ranged(df, order, partition, tie, rows_per_range)
    rows = r.rows
    if heavy:  # many rows share the order columns: cut between them as well
        r, heavy = ranged(df, order, partition, tie, rows_per_range, cut_by_hash=True)
    if heavy:  # many rows are equal altogether
        return _prefix_of_copies(df, order, sums, partition, tie, totals, rows_per_range, rows), rows
    return _with_prefix(r, sums, totals), rows


def _prefix_of_copies(df, order, sums, partition, tie, totals, rows_per_range, rows) -> DataFrame:
    """The same for a table in which copies of one row would fill a range.

    Equal rows are counted first (combined before the shuffle), the distinct rows are
    summed with that weight, and the copies are written out again by many tasks.
    """
    columns = df.columns
    distinct = df.groupBy(*[nulls.col(c) for c in columns]).agg(F.count(F.lit(1)).alias(_COPIES))
    weighted = {n: c * nulls.col(_COPIES) for n, c in sums.items()}
    r, _ = ranged(distinct, order, partition, tie, rows_per_range, cut_by_hash=True)
    out = _with_prefix(r, weighted, totals)

    chunk = F.lit(ROWS_PER_RANGE)
    starts = F.sequence(F.lit(0).cast("bigint"), nulls.col(_COPIES) - 1, chunk.cast("bigint"))
    out = out.withColumn("__start", F.explode(starts))
    # So small are these rows that by their keys a single task would get them all, and write out every copy.
    out = out.repartition(math.ceil(rows / ROWS_PER_RANGE))
    last = F.least(nulls.col("__start") + chunk, nulls.col(_COPIES))
    out = out.withColumn("__nth", F.explode(F.sequence(nulls.col("__start") + 1, last)))
    rest = nulls.col(_COPIES) - nulls.col("__nth")
    adjusted = {n: F.coalesce(nulls.col(n) - c * rest, nulls.col(n)).alias(n) for n, c in sums.items()}
    return out.select(
        *[adjusted.get(n, nulls.col(n)) for n in out.columns if n not in (_COPIES, "__start", "__nth")]
    )


def running_total(
    df: DataFrame,
    value: str,
    sort: str,
    output: str,
    partition: str | None = None,
    tie: Sequence[str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Cumulative sum in sort order; NULL where the value or the partition is NULL."""
    keys = [partition] if partition else []
    out = prefix_sums(df, [sort], {"__running": nulls.col(value)}, keys, tie, rows_per_range=rows_per_range)
    known = nulls.col(value).isNotNull()
    if partition:
        known = known & nulls.col(partition).isNotNull()
    return out.withColumn(output, F.when(known, nulls.col("__running"))).drop("__running")


def row_numbers(
    df: DataFrame,
    order: Sequence[str],
    output: str,
    tie: Sequence[str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Consecutive numbers from 1 in the given order over the whole table."""
    return prefix_sums(df, order, {output: F.lit(1).cast("bigint")}, (), tie, rows_per_range=rows_per_range)


def lagged(
    df: DataFrame,
    value: str,
    sort: str,
    periods: int,
    output: str,
    tie: Sequence[str] | None = None,
    fill: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Value `periods` rows earlier (later if negative) in the order of the whole table.

    Rows are numbered once. A row looks `periods` back inside its block of consecutive
    numbers; the rows that precede a block come with it as context, so one block never
    needs another. With `fill` a gap first takes the last value before it; the filled
    value is returned as `<output>_base`.
    """
    numbered, rows = _prefix_sums(df, [sort], {"__rn": F.lit(1).cast("bigint")}, (), tie, False, rows_per_range)
    source = nulls.col(value)
    if fill:
        numbered = _filled(numbered, value, "__filled", rows, rows_per_range)
        source = nulls.col("__filled")
    shift = abs(periods)
    block = max(rows_per_range, shift)
    own = F.floor((nulls.col("__rn") - 1) / F.lit(block)).cast("bigint")
    place = (nulls.col("__rn") - 1) % F.lit(block)
    if periods >= 0:
        neighbour = F.when(place >= block - shift, own + 1)
    else:
        neighbour = F.when(place < shift, own - 1)
    placed = numbered.withColumn("__home", own).withColumn(
        "__block", F.explode(F.array_compact(F.array(own, neighbour)))
    )
    w = Window.partitionBy("__block").orderBy("__rn")
    out = placed.withColumn("__lag", F.lag(source, periods).over(w))
    out = out.filter(F.col("__block") == F.col("__home"))
    extra = [source.alias(f"{output}_base")] if fill else []
    return out.select(*[nulls.col(c) for c in df.columns], F.col("__lag").alias(output), *extra)


def _filled(numbered: DataFrame, value: str, output: str, rows: int, rows_per_range: int) -> DataFrame:
    """Last value at or before each row number, carried across blocks of any length.

    A block's last value is carried on up and down the tree of blocks, so a gap may span any number of them.
    """
    block = F.floor((F.col("__rn") - 1) / F.lit(rows_per_range)).cast("bigint")
    numbered = numbered.withColumn("__block", block)
    known_at = F.when(nulls.col(value).isNotNull(), F.col("__rn"))
    last_of = numbered.groupBy("__block").agg(F.max_by(nulls.col(value), known_at).alias("__last"))
    earlier = before(
        last_of, (), "__block", ["__last"], math.ceil(rows / rows_per_range),
        lambda c: F.last(c, ignorenulls=True), lambda c, i: F.max_by(c, F.when(c.isNotNull(), i)), F.coalesce)
    w = Window.partitionBy("__block").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(nulls.col(value), ignorenulls=True).over(w)
    return (
        numbered.withColumn("__local", local)
        .join(earlier, "__block", "left")
        .withColumn(output, F.coalesce(F.col("__local"), F.col("__before___last")))
        .drop("__local", "__before___last", "__block")
    )
