"""Mixing sources to target weights, with DataFrame functions alone.

Words are counted per source, the targets follow by filling to a common level, each source's repetition rate
is its target over its size, and every document is emitted floor(rate) times plus once more if a uniform
number hashed from its id falls under the rate's fraction. No random state: reruns give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources the plan is sent to every executor; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target, rate`` from rows of ``source, size``.

    Sources are ordered by code point, null last, and take ``weights`` in turn. They share ``share`` times all
    sizes by weight, none above ``most`` times its own size; the excess goes to the others by weight until
    none is above. That fixed point is a common level L with target = min(most x size, L x weight): with the
    sources in order of most x size / weight, L follows from running sums at the first source that is not
    full. The windows here see one row per source, never documents. A source without words has rate 0.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    every = Window.partitionBy()
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_w", F.element_at(turn, (at % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("_full", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - before) / rest)
    by = by.withColumn("_at", F.row_number().over(order))
    free = F.when(F.col("_full") >= F.col("_level") * F.col("_w"), F.col("_at"))
    by = by.withColumn("_first", F.min(free).over(every))
    level = F.max(F.when(F.col("_at") == F.col("_first"), F.col("_level"))).over(every)
    by = by.withColumn("_share", level * F.col("_w"))
    target = F.when(F.col("_first").isNull() | (F.col("_at") < F.col("_first")), F.col("_full")).otherwise(F.least("_share", "_full"))
    by = by.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return by.select("source", "source_size", "target", rate.alias("rate"))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate) plus one with the fraction as its probability."""
    return (F.floor(rate) + F.when(uniform(seed, key) < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of each row's source; a hot source is no skew when the plan is broadcast, and
    an adaptive skew join splits it otherwise."""
    plan = plan.withColumnRenamed("source", "_source")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(plan) if small else plan, rows["source"].eqNullSafe(plan["_source"])).drop("_source")


def _key(docs: DataFrame) -> Column:
    """The document's id; where that is null, its text stands in so that such rows draw apart."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def mixing_report(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    Null text: size 0. Null source: a source of its own, last. Repeated rows draw alike. No row: no row.
    """
    sized = stage(docs.select("doc_id", "source", word_count().alias("size"), _key(docs).alias("_key")), "sizes")
    plan = stage(mixing_plan(sized, **options), "plan")
    out = _planned(sized, plan).withColumn("copies", copies(F.col("rate"), F.col("_key"), seed))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its columns unchanged."""
    plan = stage(mixing_plan(docs.select("source", word_count().alias("size")), **options), "plan").select("source", "rate")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["source"].alias("source"), _key(docs).alias("_key"))
    taken = _planned(keyed, plan).select("_row", copies(F.col("rate"), F.col("_key"), seed).alias("_n"))
    taken = taken.filter("_n > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return taken.select("_row.*")
