"""Mixing sources to target weights: whole epochs, then Efraimidis-Spirakis sampling up to the budget.

A document's key is -ln(u) / weight, with u in (0, 1) from a keyed hash of its id: the
smallest keys are a sample without replacement in which heavier documents come first. No
source is sorted as a whole. Sums of sizes per interval of keys (about the square root of
the source's rows) show in which interval the budget ends; only that one is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_weight(text: Column) -> Column:
    """Quality weight of a text: 1 without symbols, down to 0.1 where they are a tenth of it."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    share = (length - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(length, F.lit(1))
    return F.greatest(F.lit(0.1), 1.0 - 9.0 * share)


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1.0) / F.lit(float(2**52 + 2))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """source, rows, source_size, mean_key -> with target. One row per source.

    Weights repeat over the sources by code point, missing last. All share `budget` times the
    total size by weight; a target above `cap` times its source's size stops there and the
    excess is shared again, which is one level for all sources below their cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * float(budget)
        - (F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    ) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level)
    fits = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.least(F.col("most"), F.coalesce(fits * F.col("weight"), F.col("most")))).drop("level", "most")


def _sized(docs: DataFrame, quality_col: str | None, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with __source, __size, __key and __tie."""
    text = docs[text_col].cast("string")
    return docs.withColumns({
        "__source": docs[source_col].cast("string"), "__size": word_count(text),
        "__key": sampling_key(docs[id_col], docs[quality_col].cast("double") if quality_col else symbol_weight(text), seed),
        "__tie": F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))),
    })


def _interval() -> Column:
    return F.floor(F.ceil(F.sqrt("rows")) * F.col("__key") / (F.col("__key") + F.col("mean_key")))


def edges(sized: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """Per source: size, target, whole epochs, and up to which key the rest of the target reaches."""
    sources = written(
        targets(
            sized.groupBy(F.col("__source").alias("source")).agg(
                F.count("*").alias("rows"), F.sum("__size").alias("source_size"), F.avg("__key").alias("mean_key")),
            weights, budget, cap,
        ), "sources",
    ).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    rows = sized.join(sources, F.col("__source").eqNullSafe(F.col("source"))).withColumn("interval", _interval())
    so_far = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    edge = written(
        rows.groupBy("source", "interval", "rest").agg(F.sum("__size").alias("own_size"))
        .withColumn("upto", F.sum("own_size").over(so_far))
        .filter("upto >= rest").groupBy("source").agg(F.min(F.struct("interval", "upto", "own_size")).alias("e"))
        .select(F.col("source").alias("own"), F.col("e.interval").alias("edge"), (F.col("e.upto") - F.col("e.own_size")).alias("before")), "edges")
    in_edge = Window.partitionBy("source").orderBy("__key", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    last = written(
        rows.join(edge, F.col("source").eqNullSafe(F.col("own"))).filter("interval = edge")
        .withColumn("middle", F.col("before") + F.sum("__size").over(in_edge) - F.col("__size") / 2)
        .filter("middle <= rest").groupBy("source").agg(F.max(F.struct("__key", "__tie")).alias("last"))
        .select(F.col("source").alias("own"), "last"), "last")
    both = sources.join(edge, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    return written(both.join(last, F.col("source").eqNullSafe(F.col("own")), "left").drop("own"), "mix")


def _placed(sized: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.select(*[F.col(c).alias("__own" if c == "source" else c) for c in limits.columns])
    chosen = (F.col("interval") < F.col("edge")) | ((F.col("interval") == F.col("edge")) & (F.struct("__key", "__tie") <= F.col("last")))
    copies = F.when(F.col("source_size") > 0, F.col("epochs") + F.when(chosen, 1).otherwise(0)).otherwise(0).cast("long")
    return sized.join(limits, F.col("__source").eqNullSafe(F.col("__own"))).withColumn("interval", _interval()).withColumn("copies", copies)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), budget: float = 1.0, cap: float = 3.0,
    quality_col: str | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source, source_size, target, epochs, copies and taken for every row of docs.

    size: words of the text. epochs: whole passes over the source that fit its target. The
    rest of the target goes to the smallest sampling keys, prefix-summed; the document at the
    edge is taken if its middle lies within. taken = size * copies. The sources table (one row
    per source) is ordered in one task; everything else follows the session's partitions.

    Missing text: size 0. Missing source: a source of its own, last. Missing ids and repeated
    rows are rows like others; rows of one id have one key and are taken together. Quality
    weights, positive numbers, come from a column if one is named, else from the text. A source
    without words has target 0 and copies 0. Other columns are not read; empty tables give no
    rows.
    """
    slim = written(
        _sized(docs.select(*{id_col, text_col, source_col, quality_col} - {None}), quality_col, seed, id_col, text_col, source_col).select(F.col(id_col).cast("long").alias("doc_id"), "__source", "__size", "__key", "__tie"), "sizes")
    return _placed(slim, edges(slim, weights, budget, cap)).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source").alias("source"), "source_size", "target", "epochs", "copies",
        (F.col("__size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), budget: float = 1.0, cap: float = 3.0,
    quality_col: str | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with the columns of docs.

    Empty documents count with their source's epochs. The limits (one row per source) are
    joined to the documents; Spark broadcasts them while its size limit allows.
    """
    # Own names for all columns, so that none clashes with those added here.
    own = {c: f"__column_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*own.values())
    sized = _sized(renamed, own[quality_col] if quality_col else None, seed, own[id_col], own[text_col], own[source_col])
    slim = written(sized.select("__source", "__size", "__key", "__tie"), "sizes")
    placed = _placed(sized, edges(slim, weights, budget, cap))
    return placed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col(name).alias(c) for c, name in own.items()])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370498.0)
         / greatest(0.1::DOUBLE, 1.0::DOUBLE - 9.0::DOUBLE * ((length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
                                     / greatest(length(coalesce(text, '')), 1)::DOUBLE)) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
aimed AS (
  SELECT source, source_size,
         least(most, coalesce((max(CASE WHEN level <= most / weight THEN level END) OVER ()) * weight, most)) AS target
  FROM leveled),
placed AS (
  SELECT s.*, a.source_size, a.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         size * (floor(target / source_size)::BIGINT
                 + CASE WHEN middle <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM placed
"""
