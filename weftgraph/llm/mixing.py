"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import TOKEN_CLASS, cut, without

#: Sources that may be broadcast with their cut-offs; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_CLASS)), F.lit(0)).cast("long")


def _before(df: DataFrame, order: Sequence[Column], values: Sequence[str], few: bool) -> DataFrame:
    """df with the sums of values over all rows that come before, as before_<value>; the order must be total. Few rows go
    through one task; of more, range partitions are summed, then the rows within one, so that no task sees all."""
    if few:
        up = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(up), F.lit(0)).alias(f"before_{v}") for v in values])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sums = rows.groupBy("_p").agg(*[F.sum(v).alias(v) for v in values])
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(v).over(up), F.lit(0)).alias(f"_{v}") for v in values])
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return out.select(*df.columns, *[(F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"_{v}")).alias(f"before_{v}") for v in values])


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float, one_task: int = BROADCAST_SOURCES) -> DataFrame:
    """sizes (source, source_size) with weight and target: budget * all sizes shared by weight, no source
    above most * its size, the excess shared again by weight among the others. Up to one_task sources are put in order by one
    task."""
    by_name = F.asc_nulls_last("source")
    sizes = cut(sizes)
    few = sizes.count() <= one_task
    s = _before(sizes.select("source", "source_size", F.lit(1).alias("one")), [by_name], ["one"], few)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("before_one", F.lit(len(weights))) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("weight")).withColumn("full", F.lit(float(most)) * F.col("source_size"))
    # Sources fill up in order of full / weight; the level is that of the first which does not. Later ones
    # would give lower levels, as they leave out what the others ask for.
    s = _before(s.withColumn("ratio", F.col("full") / F.col("weight")), [F.asc("ratio"), by_name], ["full", "weight"], few)
    total, all_weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(float(budget) * float(total or 0)) - F.col("before_full")
    s = cut(s.withColumn("level", left / (F.lit(float(all_weights or 1)) - F.col("before_weight"))))
    top = s.where("level <= ratio").agg(F.max("level")).first()[0]
    reached = F.col("full") if top is None else F.least("full", F.lit(float(top)) * F.col("weight"))
    return s.select("source", "source_size", "weight", reached.alias("target"))


def queue(slim: DataFrame, goal: DataFrame, most: int, bucket_rows: int = 2_000) -> DataFrame:
    """Virtual finish times: slim (source, turn, words; one row per source and turn) repeated `most` times.

    `start` and `finish` are a row's cumulative source words, before and after it, divided by the source's target.
    The running sum is two-level: sums of buckets of turns, then rows within a bucket, so that no source's
    rows meet in one task.
    """
    n = cut(slim.select("source", "turn", "words"))
    rows = n.count()
    # as many rows in a bucket as buckets, once there are enough: neither side of the sum grows in step with the rows
    buckets = max(1, rows // max(bucket_rows, math.isqrt(rows)))
    n = n.withColumn("bucket", F.pmod(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / F.lit(2.0**32), F.lit(float(buckets))).cast("int"))
    sums = n.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("source", "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("inner", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    n = n.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    g = goal.select(F.col("source").alias("s"), "source_size", "target")
    n = n.join(g, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    n = n.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    before = F.col("round") * F.col("source_size") + F.col("ahead") + F.col("inner")
    goal_words = F.when(F.col("target") > 0, F.col("target"))  # a source without words has no virtual time
    return n.select("source", "turn", "round", "words", "target", (before / goal_words).alias("start"), ((before + F.col("words")) / goal_words).alias("finish"), before.alias("before"))


def cut_offs(queued: DataFrame, budget: Column | int) -> DataFrame:
    """(source, rounds, last, part): what each source has had when the total budget is spent.

    Rows are range-sorted by the virtual time at which their service ends, words served are added up over the
    sorted partitions, and the list is truncated at the budget. In virtual time 1 every source has had its target;
    the row that is in service then counts with the words served so far.
    """
    served = F.least(F.col("words"), F.round(F.col("target")).cast("long") - F.col("before"))
    rows = queued.where("words > 0 and start < 1").withColumn("served", served).where("served > 0")
    parts = int(queued.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("ends", F.least(F.col("finish"), F.lit(1.0)))
    rows = cut(rows.repartitionByRange(parts, "ends", "turn").withColumn("pid", F.spark_partition_id()).select("source", "turn", "round", "words", "ends", "served", "pid"))
    sums = rows.groupBy("pid").agg(F.sum("served").alias("n"))
    sums = sums.select(F.col("pid").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("n").over(Window.orderBy("pid")).alias("upto"))
    # Only the partition in which the budget ends needs its rows' running sum.
    at = rows.join(F.broadcast(sums), rows.pid == F.col("p"))
    whole = at.where(F.col("upto") <= budget)
    edge = at.where((F.col("upto") > budget) & (F.col("ahead") < budget))
    upto = F.col("ahead") + F.sum("served").over(Window.partitionBy("pid").orderBy("ends", "turn", F.asc_nulls_last("source"), "round"))
    edge = edge.withColumn("served", F.least(F.col("served"), budget - (upto - F.col("served")))).where("served > 0")
    taken = whole.select("source", "turn", "round", "words", "served").unionByName(edge.select("source", "turn", "round", "words", "served"))
    last = F.max(F.struct("round", "turn", "served", "words"))
    return taken.groupBy("source").agg(last.alias("l")).select("source", F.col("l.round").alias("rounds"), F.col("l.turn").alias("last"), F.col("l.served").alias("part"), F.col("l.words").alias("of"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """docs with size, source_size, target and taken added: the words of each document that a mix takes.

    A document's size is its number of `[^\\x20\\x09-\\x0D]+` (null: 0). Sources in code-point order, null last,
    get the weights in turn and share budget times all sizes; a target stops at `most` times its source's size
    and the excess goes to the others by weight. Documents are shuffled by a digest of id and text, so reruns
    agree. A source is read in rounds; `taken` is the document's size times the full rounds it is in, plus what
    the last round takes of it: documents before the cut-off whole, the one in service when the budget is
    spent in part. Rows that repeat in source, id and text share their words evenly (to a word). Documents
    without words and sources without words take none; an empty table gives an empty result. Columns of docs with
    the names of the added ones are replaced.
    """
    docs = without(docs, "size", "source_size", "target", "taken", "_turn")
    turn = F.md5(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    sized = docs.withColumn("size", n_tokens(F.col("text"))).withColumn("_turn", turn)
    slim = cut(sized.groupBy("source", F.col("_turn").alias("turn")).agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    goal = cut(targets(slim.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most))
    n, total = goal.agg(F.count("*"), F.sum("target")).first()
    last = cut_offs(queue(slim, goal, most), F.lit(int(round(total or 0))))
    side = F.broadcast if n <= BROADCAST_SOURCES else (lambda df: df)
    per_source = cut(goal.select(F.col("source").alias("_s"), "source_size", "target").join(last.withColumnRenamed("source", "_l"), F.col("_s").eqNullSafe(F.col("_l")), "left").drop("_l"))
    out = sized.join(side(per_source), F.col("source").eqNullSafe(F.col("_s")), "left")
    in_round = F.when(F.col("_turn") < F.col("last"), F.col("size")).when(F.col("_turn") == F.col("last"), F.floor(F.col("size") * F.col("part") / F.col("of"))).otherwise(0)
    taken = F.coalesce(F.col("rounds") * F.col("size") + in_round, F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"))
