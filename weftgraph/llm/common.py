"""Helpers shared by the training-data operators: shared-folder checkpoints, byte-level word kernels, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the contracts, and words of its complement.
SPACE_CLASS = r"[\x20\x09-\x0D]"
TOKEN_CLASS = r"[^\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SPACES = b" \t\n\x0b\x0c\r"


def _table(keep) -> bytes:
    return bytes((c + 32 if 65 <= c <= 90 else c) if keep(c) else 32 for c in range(256))


#: Over UTF-8 bytes: ASCII letters become lower case and every byte that is not part of a word a blank.
WORD_BYTES = _table(lambda c: c >= 128 or chr(c).isalnum())
TOKEN_BYTES = _table(lambda c: c not in _SPACES)

#: Bytes of text that kernels take at once: their scratch arrays are some forty times as large.
CHUNK = 1 << 18


#: Narrow rows, as those of edges, in a part that is written.
ROWS_A_PART = 100_000


def with_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only in local mode a temporary one is made up where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="weftgraph-checkpoints-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files. If its number of rows is known, in as few parts as
    that asks for."""
    with_checkpoints(df.sparkSession)
    return (df if rows is None else df.coalesce(16 + rows // ROWS_A_PART)).checkpoint()


def materialised(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and the folder's path."""
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that `materialised` has written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of rows that go to a Python worker at once: a batch is held by the executor and by its worker.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def bounded_batches(df: DataFrame) -> None:
    """Bound Arrow batches by bytes, as texts differ in length by orders of magnitude; a bound set by the user stays."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH_KEY, None)).lower().rstrip("b")
    if not now.isdigit() or int(now) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_in(doc_id: Column, remainder: int) -> Column:
    """crc32(doc_id as text) mod 5 == remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == remainder


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_hash(doc_id: str, text: str = "text") -> Column:
    """A 64-bit hash of a document's id and text; with the id it names a row, up to exact repetitions."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


#: Rows of a join side that is sent to every executor; the side's rows are counted first.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, which has been written, marked for broadcast if it is counted and has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs that decisions (doc_id, rowkey, kept; one per row) keep, with the columns of docs.

    Rows that repeat in both id and text are one document: if it is kept, one of them stays.
    The keys to drop are broadcast only if counted and few, else joined by shuffle.
    """
    decisions = cut(decisions.select(F.col("doc_id").alias("k_id"), F.col("rowkey").alias("k_row"), "kept"))
    keys = decisions.groupBy("k_id", "k_row").agg((F.min("kept") & (F.count("*") == 1)).alias("whole"), F.max("kept").alias("any_kept")).where("not whole")
    drop = cut(keys.select("k_id", "k_row", "any_kept"))
    n, repeats = drop.agg(F.count("*"), F.coalesce(F.sum(F.col("any_kept").cast("int")), F.lit(0))).first()
    if not n:
        return docs
    side = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    here = F.col("doc_id").eqNullSafe(F.col("k_id")) & (row_hash("doc_id") == F.col("k_row"))
    out = docs.join(side(drop), here, "left_anti")
    if repeats:
        again = docs.join(side(drop.where("any_kept")), here, "left_semi")
        out = out.unionByName(again.dropDuplicates(["doc_id", "text"]))
    return out


def sketch(df: DataFrame, number: Column, bits: int) -> np.ndarray:
    """A bitmap of fixed size, 2**bits, set at the low bits of each row's number. What it lacks is not in df."""
    bit = number.bitwiseAND(F.lit((1 << bits) - 1))
    cells = df.select(F.shiftright(bit, 6).alias("cell"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    cells = cells.select("cell", F.expr("shiftleft(1L, b)").alias("v")).groupBy("cell").agg(F.bit_or("v").alias("v"))
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    for cell, v in cells.toLocalIterator():
        out[cell] = np.uint64(v & (2**64 - 1))
    return out


# ---------------------------------------------------------------- texts as bytes


def pieces(texts: pa.Array, table: bytes, limit: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, end, bytes, offsets) for runs of texts of about `limit` bytes: text i of a run is
    bytes[offsets[i] : offsets[i + 1] - 1], translated by table and followed by a blank. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = memoryview(texts.buffers()[2] or b"")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        joined = b" ".join([data[at[i] : at[i + 1]] for i in range(lo, hi)]) + b" "
        yield lo, hi, joined.translate(table), at[lo : hi + 1] - at[lo] + np.arange(hi - lo + 1)
        lo = hi


#: Fixed odd factor (3 mod 4) of the positional word hash.
_BASE = np.uint64(0x9E3779B97F4A7C17)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE[32] = 0
_power = np.multiply.accumulate(np.full(4096, _BASE))


def _powers(n: int) -> np.ndarray:
    global _power
    if n > len(_power):
        _power = np.multiply.accumulate(np.full(n * 2, _BASE))
    return _power


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and non-zero 64-bit hashes of the blank-separated words."""
    b = np.frombuffer(data, np.uint8)
    word = b != 32
    word[1:] &= b[:-1] == 32
    starts = np.flatnonzero(word)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = starts[0]
    b = b[first:]
    run = np.diff(np.append(starts, first + len(b)))
    place = np.arange(len(b), dtype=np.int64) - np.repeat(starts - first, run)
    h = np.add.reduceat(_BYTE[b] * _powers(int(run.max()) + 1)[place], starts - first)
    h = mix(h)
    h[h == 0] = 1
    return starts, h


def hashed_words(texts: pa.Array, table: bytes, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, hashes, ends) for runs of texts: 64-bit hashes of all words of the run, and
    ends[i], where the words of text i of the run end. Texts over `limit` are hashed part by part."""
    for lo, hi, data, at in pieces(texts, table, limit):
        if len(data) <= 2 * limit:
            starts, h = hash_words(data)
            yield lo, hi, h, np.searchsorted(starts, at[1:])
            continue
        parts, here = [], 0
        while here < len(data):
            stop = data.find(b" ", min(here + limit, len(data) - 1)) + 1
            parts.append(hash_words(data[here:stop])[1])
            here = stop
        h = np.concatenate(parts)
        yield lo, hi, h, np.array([len(h)])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive entries, for each start that has them."""
    n = max(0, len(h) - k + 1)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = x * _BASE + h[j : j + n]
    return mix(x)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of an edge is connected with.

    Alternates large-star and small-star steps (each a groupBy for the minimum and a join) until only stars are
    left; every step's edges are checkpointed, so neither lineage nor driver state grows. So are the minima, as a join can
    be split at a node with very many edges only if both its sides come straight from a shuffle. Keys may be of any
    ordered type.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct())
    while n := _tangled(e):
        both = e.union(e.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), n)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _tangled(e: DataFrame) -> int:
    """The number of ends of the edges (u, v), u > v; 0 if each node is either a center or a leaf of one center."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("center")).union(e.select(F.col("v").alias("x"), F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.sum("center").alias("center"))
    n, worst = ends.agg(F.coalesce(F.sum(F.col("leaf") + F.col("center")), F.lit(0)), F.max(F.col("leaf") + F.least("center", F.lit(1)))).first()
    return n if n and worst > 1 else 0
