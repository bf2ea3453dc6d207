"""Exact deduplication by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, cut, keep_rows, row_hash

_BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _BLANKS, "")


_RUNS = "rowkey long, rid {0}, chars long, lead boolean, pid int, run int, size long, open boolean, keep_rid {0}, keep_chars long, text_sha256 string, edge string"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows: compare each normalised text with its neighbour's, and describe each run of equals.

    Rows of a run arrive best first. Only the row numbers of the current run are held. A partition's
    first and last run may go on in a neighbouring partition: they are marked open and carry their text once.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    run, text, rows, out, held = 0, None, [], [], 0
    kind = schema = None

    def close(last: bool) -> None:
        nonlocal held
        first = run == 0 or last
        digest = hashlib.sha256(text.encode()).hexdigest()
        keep_key, keep_rid, keep_chars = rows[0]
        n = len(rows)
        for start in range(0, n, 50_000):
            part = rows[start : start + 50_000]
            m = len(part)
            out.append(pa.record_batch([
                pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], kind), pa.array([r[2] for r in part], pa.int64()),
                pa.array([start == 0 and i == 0 for i in range(m)], pa.bool_()),
                pa.array([pid] * m, pa.int32()), pa.array([run] * m, pa.int32()), pa.array([n] * m, pa.int64()), pa.array([first] * m, pa.bool_()),
                pa.array([keep_rid] * m, kind), pa.array([keep_chars] * m, pa.int64()), pa.array([digest] * m, pa.string()),
                pa.array([text if first and start == 0 and i == 0 else None for i in range(m)], pa.string()),
            ], schema=schema))
        held += n

    for batch in batches:
        if schema is None:
            kind = batch.schema.field("rid").type
            schema = pa.schema([("rowkey", pa.int64()), ("rid", kind), ("chars", pa.int64()), ("lead", pa.bool_()), ("pid", pa.int32()), ("run", pa.int32()), ("size", pa.int64()), ("open", pa.bool_()), ("keep_rid", kind), ("keep_chars", pa.int64()), ("text_sha256", pa.string()), ("edge", pa.string())])
        norm = batch.column("norm")
        for t, key, rid, chars in zip(norm.to_pylist(), batch.column("rowkey").to_pylist(), batch.column("rid").to_pylist(), batch.column("chars").to_pylist(), strict=True):
            if t != text:
                if rows:
                    close(False)
                    run += 1
                text, rows = t, []
            rows.append((key, rid, chars))
        if held >= 5_000:
            yield pa.Table.from_batches(out, schema).combine_chunks().to_batches()[0]
            out, held = [], 0
    if rows:
        close(True)
    if out:
        yield from pa.Table.from_batches(out, schema).to_batches()


def exact_groups(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, rowkey, chars, keep_id, group_size, kept, text_sha256): one row per row of docs.

    Texts are equal when identical after white space is deleted; a null text is an empty one. The row with
    the most code points stays, then the smallest doc_id; a null doc_id comes after all others. Rows alike in
    text length and doc_id are one document repeated: exactly one of them is kept. doc_id may be of any ordered type.
    Other columns are ignored, whatever their names. An empty table gives an empty result.

    Method: sampled splitters over a 32-character prefix, a hash of the whole normalised text and a row hash
    range-partition the rows, so that equal texts are neighbours in the global order while one huge group still
    spreads over many partitions; each partition is sorted externally by whole text, and neighbours are
    compared in full. Runs that reach a partition's edge are merged by their full text: at most two a
    partition.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    norm = normalised(F.col("text"))
    docs = docs.select(F.col("doc_id").alias("rid"), "text")
    rows = docs.select("rid", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"), norm.alias("norm"), "text")
    rows = rows.select("*", F.substring("norm", 1, 32).alias("head"), F.xxhash64("norm").alias("whole"), row_hash("rid", "text").alias("rowkey"))
    spread = rows.repartitionByRange(n, "head", "whole", "rowkey").drop("text")
    ordered = spread.sortWithinPartitions("head", "whole", "norm", F.desc("chars"), F.asc_nulls_last("rid"))
    found = cut(ordered.select("norm", "rowkey", "rid", "chars").mapInArrow(_neighbours, _RUNS.format(docs.schema["rid"].dataType.simpleString())))

    # Runs at edges: one row per run, then one per text.
    best = F.min(F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_rid").isNull().alias("n"), F.col("keep_rid").alias("i"), F.col("pid").alias("p"), F.col("run").alias("r")))
    edges = found.where("open and edge is not null").select("edge", "pid", "run", "size", "keep_rid", "keep_chars")
    merged = edges.groupBy("edge").agg(F.sum("size").alias("size2"), best.alias("best"))
    fixed = edges.select("edge", "pid", "run").join(merged, "edge").select("pid", "run", "size2", "best")
    inner = found.where("not open").select("rid", "rowkey", "chars", "keep_rid", "size", "text_sha256", F.col("lead").alias("kept"))
    own = F.col("lead") & (F.col("best.p") == F.col("pid")) & (F.col("best.r") == F.col("run"))
    outer = found.where("open").join(fixed, ["pid", "run"]).select("rid", "rowkey", "chars", F.col("best.i").alias("keep_rid"), F.col("size2").alias("size"), "text_sha256", own.alias("kept"))
    return inner.unionByName(outer).select(F.col("rid").alias("doc_id"), "rowkey", "chars", F.col("keep_rid").alias("keep_id"), F.col("size").alias("group_size"), "kept", "text_sha256")


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows of docs that exact_groups keeps, with the columns of docs."""
    return keep_rows(docs, exact_groups(docs, partitions))
