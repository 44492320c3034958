"""Consumer groups over streams.

Groups: ``stream, grp, created_ms, delivered_ms, delivered_seq, committed_ms, committed_seq``. Pending entries:
``stream, grp, ms, seq, consumer, delivered_at, times``. Every function takes ``now_ms`` where time matters and
returns new tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.streaming.log import _literal, entry_id, parse_id

ID = ["stream", "grp", "ms", "seq"]
GROUP = ["stream", "grp"]
PENDING = [*ID, "consumer", "delivered_at", "times"]


def create(groups: DataFrame, log: DataFrame, streams: DataFrame, grp: str, start: str, now_ms: int) -> DataFrame:
    """A group at an id, or at ``$``, the last one, for each of ``streams``; one that exists is an error."""
    if groups.filter(F.col("grp") == grp).join(streams.select("stream"), "stream", "left_semi").limit(1).count():
        raise CommandError("BUSYGROUP the group exists already")
    new = streams.select("stream").distinct()
    if start == "$":
        new = new.join(log.groupBy("stream").agg(F.max(entry_id()).alias("_at")), "stream", "left").withColumn("_at", F.coalesce("_at", _literal(0, 0)))
    else:
        ms, seq, _ = parse_id(start)
        new = new.withColumn("_at", _literal(ms, seq))
    marks = [F.col(f"_at.{p}").alias(f"{m}_{p}") for m in ("delivered", "committed") for p in ("ms", "seq")]
    return groups.unionByName(new.select("stream", F.lit(grp).alias("grp"), F.lit(now_ms).cast("long").alias("created_ms"), *marks))


def destroy(groups: DataFrame, pending: DataFrame, grp: str) -> tuple[DataFrame, DataFrame]:
    return groups.filter(F.col("grp") != grp), pending.filter(F.col("grp") != grp)


def set_id(groups: DataFrame, grp: str, ms: int, seq: int) -> DataFrame:
    """Moves both marks; pending entries stay."""
    own = F.col("grp") == grp
    for m in ("delivered", "committed"):
        groups = groups.withColumn(f"{m}_ms", F.when(own, F.lit(ms)).otherwise(F.col(f"{m}_ms"))).withColumn(f"{m}_seq", F.when(own, F.lit(seq)).otherwise(F.col(f"{m}_seq")))
    return groups


def restarted(groups: DataFrame) -> DataFrame:
    """What a restart leaves: delivery resumes at the committed mark."""
    return groups.withColumn("delivered_ms", F.col("committed_ms")).withColumn("delivered_seq", F.col("committed_seq"))


def delete_consumer(pending: DataFrame, grp: str, consumer: str) -> DataFrame:
    return pending.filter((F.col("grp") != grp) | (F.col("consumer") != consumer))


def deliver(log: DataFrame, groups: DataFrame, consumer: str, now_ms: int, count: int = 1000) -> DataFrame:
    """New entries past each group's delivered mark, at most ``count`` a group: rows of pending entries.

    ``advance`` moves the marks by them."""
    rows = log.join(groups, "stream").filter(entry_id() > entry_id("delivered_ms", "delivered_seq"))
    n = F.row_number().over(Window.partitionBy(*GROUP).orderBy("ms", "seq"))
    rows = rows.withColumn("_n", n).filter(F.col("_n") <= count)
    return rows.select(*ID, F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("delivered_at"), F.lit(1).alias("times"))


def advance(groups: DataFrame, delivered: DataFrame) -> DataFrame:
    last = delivered.groupBy(*GROUP).agg(F.max(entry_id()).alias("_last"))
    rows = groups.join(last, GROUP, "left")
    for p in ("ms", "seq"):
        rows = rows.withColumn(f"delivered_{p}", F.coalesce(F.col(f"_last.{p}"), F.col(f"delivered_{p}")))
    return rows.drop("_last")


def replay(log: DataFrame, pending: DataFrame, consumer: str, start: str, count: int, now_ms: int) -> DataFrame:
    """A consumer's own pending entries past an id. The first ``count`` rows are taken before the consumer is
    looked at, and what is replayed counts as delivered once more."""
    ms, seq, _ = parse_id(start)
    n = F.row_number().over(Window.partitionBy(*GROUP).orderBy("ms", "seq"))
    rows = pending.filter(entry_id() > _literal(ms, seq)).withColumn("_n", n).filter(F.col("_n") <= count)
    own = rows.filter(F.col("consumer") == consumer).join(log.select("stream", "ms", "seq"), ["stream", "ms", "seq"], "left_semi")
    return own.select(*ID, "consumer", F.lit(now_ms).cast("long").alias("delivered_at"), (F.col("times") + 1).alias("times"))


def ack(groups: DataFrame, pending: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Acknowledges rows of ``stream, grp, ms, seq``: the reply, the groups and what stays pending.

    The reply counts ids above the old committed mark, repeated ones each time; the mark moves to the largest.
    """
    old = groups.select(*GROUP, entry_id("committed_ms", "committed_seq").alias("_old"))
    rows = ids.join(old, GROUP)
    reply = rows.groupBy(*GROUP).agg(F.sum(F.when(entry_id() > F.col("_old"), 1).otherwise(0)).alias("acked"))
    top = ids.groupBy(*GROUP).agg(F.max(entry_id()).alias("_top"))
    moved = groups.join(top, GROUP, "left").withColumn("_new", F.greatest(entry_id("committed_ms", "committed_seq"), F.col("_top")))
    for p in ("ms", "seq"):
        moved = moved.withColumn(f"committed_{p}", F.col(f"_new.{p}"))
    return reply, moved.drop("_top", "_new"), pending.join(ids.select(*ID).distinct(), ID, "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    """``stream, grp, total, first, last, consumers``: names with how many entries each has."""
    each = pending.groupBy(*GROUP, "consumer").agg(F.count("*").alias("n"), F.min(entry_id()).alias("lo"), F.max(entry_id()).alias("hi"))
    names = F.sort_array(F.collect_list(F.struct("consumer", "n")))
    return each.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.min("lo").alias("first"), F.max("hi").alias("last"), names.alias("consumers"))


def pending_range(pending: DataFrame, start: str, stop: str, count: int, now_ms: int, min_idle: int = 0, consumer: str | None = None) -> DataFrame:
    """``stream, grp, ms, seq, consumer, idle, times`` between two ids, the first ``count`` of each group."""
    (a, b, no_a), (c, d, no_b) = parse_id(start), parse_id(stop, last=True)
    own, idle = entry_id(), F.lit(now_ms) - F.col("delivered_at")
    rows = pending.filter((own > _literal(a, b) if no_a else own >= _literal(a, b)) & (own < _literal(c, d) if no_b else own <= _literal(c, d)) & (idle >= min_idle))
    rows = rows.filter(F.col("consumer") == consumer) if consumer else rows
    n = F.row_number().over(Window.partitionBy(*GROUP).orderBy("ms", "seq"))
    return rows.withColumn("_n", n).filter(F.col("_n") <= count).select(*ID, "consumer", idle.alias("idle"), "times")


def claim(log: DataFrame, pending: DataFrame, ids: DataFrame, consumer: str, min_idle: int, now_ms: int, force: bool = False, just_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is claimed of rows of ``stream, grp, ms, seq``, and the pending entries afterwards.

    Entries idle for ``min_idle`` change their owner and count one delivery more, unless only ids are wanted;
    ``force`` takes entries that nobody has. A claimed entry that the log no longer holds goes silently.
    """
    asked = ids.select(*ID).distinct()
    idle = F.lit(now_ms) - F.col("delivered_at") >= min_idle
    hit = pending.filter(idle).join(asked, ID, "left_semi").select(*ID, (F.col("times") + (0 if just_id else 1)).alias("times"))
    if force:
        free = asked.join(pending.select(*ID), ID, "left_anti").select(*ID, F.lit(0 if just_id else 1).alias("times"))
        hit = hit.unionByName(free)
    taken = hit.join(log.select("stream", "ms", "seq"), ["stream", "ms", "seq"], "left_semi")
    taken = taken.select(*ID, F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("delivered_at"), "times")
    return taken, pending.join(hit.select(*ID), ID, "left_anti").unionByName(taken)


def autoclaim(log: DataFrame, pending: DataFrame, consumer: str, min_idle: int, start: str, now_ms: int, count: int = 100) -> DataFrame:
    """One page of claims a group, in order of ids from ``start``: rows of what was scanned with ``outcome``
    ``claimed``, ``deleted`` (the log no longer holds it) or ``busy`` (not idle enough).

    The scan ends with the ``count``-th claim or after 10 x ``count`` rows; the next cursor follows its last
    row. Only these first rows of a group are brought together; running counts in the order of ids find the end.
    """
    ms, seq, _ = parse_id(start)
    there = log.select("stream", "ms", "seq").withColumn("_there", F.lit(True))
    rows = pending.filter(entry_id() >= _literal(ms, seq)).join(there, ["stream", "ms", "seq"], "left")
    old = F.lit(now_ms) - F.col("delivered_at") >= min_idle
    outcome = F.when(~old, "busy").when(F.col("_there").isNull(), "deleted").otherwise("claimed")
    order = Window.partitionBy(*GROUP).orderBy("ms", "seq")
    rows = rows.withColumn("scanned", F.row_number().over(order)).filter(F.col("scanned") <= 10 * count).withColumn("outcome", outcome)
    claims = F.sum(F.when(F.col("outcome") == "claimed", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(claims, F.lit(0))).filter(F.col("_before") < count)
    return rows.select(*ID, "outcome", (F.col("times") + F.when(F.col("outcome") == "claimed", 1).otherwise(0)).alias("times"), F.when(F.col("outcome") == "claimed", F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"))


def next_cursor(scanned: DataFrame) -> DataFrame:
    """The id after a page's last row."""
    last = scanned.groupBy(*GROUP).agg(F.max(entry_id()).alias("_l"))
    return last.select(*GROUP, F.col("_l.ms").alias("ms"), (F.col("_l.seq") + 1).alias("seq"))


def backlog(log: DataFrame, groups: DataFrame) -> DataFrame:
    """``stream, grp, n``: entries past each group's committed mark."""
    past = entry_id() > entry_id("committed_ms", "committed_seq")
    rows = groups.join(log, "stream", "left")
    return rows.groupBy(*GROUP).agg(F.sum(F.when(F.col("ms").isNotNull() & past, 1).otherwise(0)).alias("n"))


def consumers(pending: DataFrame, now_ms: int) -> DataFrame:
    return pending.groupBy(*GROUP, "consumer").agg(F.count("*").alias("pending"), (F.lit(now_ms) - F.max("delivered_at")).alias("idle"))


def xinfo_groups(groups: DataFrame) -> DataFrame:
    """``stream, grp, last_delivered, committed``: the two marks as ids."""
    return groups.select(*GROUP, entry_id("delivered_ms", "delivered_seq").alias("last_delivered"), entry_id("committed_ms", "committed_seq").alias("committed"))
