"""Line deduplication with a log-template tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftgraph.llm.common import BROADCAST_ROWS, bounded_batches, cut, hash_words, mix, pieces, row_hash, sketch, small, without

_PLAIN = bytes(range(256))
_BLANK = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))
_STAR = np.uint64(3)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Tree:
    """lead: leading tokens on a line's way through the tree, after its number of tokens.

    A template recurs if lines of `docs` different texts have it; lines of `long` tokens and over need two.
    `constant` is the least share of a template's tokens that are not variable. Leaves of up to `lines` lines are taken
    apart in tasks of about `tokens` tokens.
    """

    lead: int = 2
    docs: int = 3
    long: int = 50
    constant: float = 0.6
    lines: int = 4096
    tokens: int = 1_000_000
    sketch_bits: int = 25


def _lines(texts: pa.Array, t: Tree):
    """For runs of texts: token hashes, and for each line with tokens its text, number, first token, tokens and tokens
    without a digit, leaf, line hash, and line hash with its digits; and each text's number of lines. Tokens with a digit are variable."""
    for lo, hi, raw, at in pieces(texts, _PLAIN):
        starts, h = hash_words(raw.translate(_BLANK))
        b = np.frombuffer(raw, np.uint8)
        ends = np.sort(np.concatenate([np.flatnonzero(b == 10), at[1:] - 1]))
        of_text = np.searchsorted(at, ends, "right") - 1
        n_lines = np.bincount(of_text, minlength=hi - lo)
        first_line = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
        n_lines[np.diff(at) == 1] = 0
        if not len(h):
            yield lo, hi, n_lines, h, np.empty((0, 5), np.int64), h, h, h
            continue
        digits = np.add.reduceat(((b >= 48) & (b <= 57)).astype(np.int32), starts)
        star = digits > 0
        line = np.searchsorted(ends, starts)
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.append(begin, len(h)))
        place = (np.arange(len(h)) - np.repeat(begin, size)).astype(np.uint64)
        place = mix(place * _ODD)
        placed = mix(h + place)
        exact = np.add.reduceat(placed, begin) + size.astype(np.uint64)
        placed[star] = mix(_STAR + place[star])
        h = np.where(star, _STAR, h)
        whole = np.add.reduceat(placed, begin) + size.astype(np.uint64)
        leaf = size.astype(np.uint64) * _ODD
        for j in range(t.lead):
            leaf = mix(leaf + np.where(size > j, h[np.minimum(begin + j, len(h) - 1)], np.uint64(0)))
        which = line[begin]
        rows = np.stack([of_text[which], which - first_line[of_text[which]], begin, size, np.add.reduceat((~star).astype(np.int64), begin)], axis=1)
        yield lo, hi, n_lines, h, rows, leaf, whole, exact


def _mapped(t: Tree):
    """Number of lines, and the lines with tokens: number, leaf, hashes and numbers of tokens and of those without a digit."""

    @arrow_udf("struct<n_lines:long,lines:array<struct<line:long,leaf:long,whole:long,exact:long,n:long,plain:long>>>")
    def mapped(texts: pa.Array) -> pa.Array:
        counts, sizes, columns = [], [], [[], [], [], [], [], []]
        for lo, hi, n_lines, _, rows, leaf, whole, exact in _lines(texts, t):
            counts.append(n_lines)
            sizes.append(np.bincount(rows[:, 0], minlength=hi - lo))
            for x, v in zip(columns, (rows[:, 1], leaf.view(np.int64), whole.view(np.int64), exact.view(np.int64), rows[:, 3], rows[:, 4]), strict=True):
                x.append(v)
        return pa.StructArray.from_arrays([pa.array(_joined(counts)), _listed(sizes, columns, ["line", "leaf", "whole", "exact", "n", "plain"])], names=["n_lines", "lines"])

    return mapped


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def _offsets(sizes: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(_joined(sizes))]).astype(np.int32))


def _listed(sizes: list[np.ndarray], columns: list[list[np.ndarray]], names: list[str], *more: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(sizes), pa.StructArray.from_arrays([*(pa.array(_joined(c)) for c in columns), *more], names=names))


def _has(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    low = keys & np.uint64((1 << width) - 1)
    return ((bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def _opened(t: Tree, leaves):
    """Lines whose leaf the bitmap has, once within a run of texts, with 32 bits of each token; 0 is a variable one."""

    @arrow_udf("array<struct<leaf:long,whole:long,tokens:array<int>>>")
    def opened(texts: pa.Array) -> pa.Array:
        sizes, columns, lengths, values = [], [[], []], [], []
        for lo, hi, _, h, rows, leaf, whole, _ in _lines(texts, t):
            pick = np.flatnonzero(_has(leaves.value, leaf, t.sketch_bits))
            pick = pick[np.sort(np.unique(whole[pick], return_index=True)[1])]
            rows = rows[pick]
            sizes.append(np.bincount(rows[:, 0], minlength=hi - lo))
            columns[0].append(leaf[pick].view(np.int64))
            columns[1].append(whole[pick].view(np.int64))
            n = rows[:, 3]
            lengths.append(n)
            token = h[np.repeat(rows[:, 2] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            values.append(np.where(token == _STAR, 0, (token >> np.uint64(32)) | np.uint64(1)).astype(np.uint32))
        flat = np.concatenate(values).view(np.int32) if values else np.empty(0, np.int32)
        return _listed(sizes, columns, ["leaf", "whole", "tokens"], pa.ListArray.from_arrays(_offsets(lengths), pa.array(flat)))

    return opened


def _enough(key: np.ndarray, line: np.ndarray, lines: pd.DataFrame) -> np.ndarray:
    """Of entries (key, line), which have a key that lines of enough different texts have."""
    _, own = np.unique(key, return_inverse=True)
    texts, need = lines.texts.to_numpy()[line], lines.need.to_numpy()[line]
    enough = np.zeros(own.max(initial=-1) + 1, bool)
    enough[own[texts >= need]] = True
    few = texts < need
    held = np.concatenate([own[few], own[few]])
    content = np.concatenate([lines[c].to_numpy()[line[few]] for c in ("first", "last")])
    _, once = np.unique(mix(content.view(np.uint64) + mix(held.astype(np.uint64) * _ODD)), return_index=True)
    needs = np.zeros(len(enough), np.int64)
    needs[own] = need
    enough |= np.bincount(held[once], minlength=len(enough)) >= needs
    return enough[own]


def _templates(t: Tree):
    """The lines of whole leaves whose templates recur."""

    def find(group: pa.Table) -> pa.Table:
        lines = group.drop_columns(["tokens"]).to_pandas()
        tokens = group.column("tokens").combine_chunks()
        flat = np.asarray(tokens.values)[tokens.offsets[0].as_py() : tokens.offsets[-1].as_py()].view(np.uint32).astype(np.uint64)
        leaf, n = lines.leaf.to_numpy().view(np.uint64), lines.n.to_numpy()
        line = np.repeat(np.arange(len(lines)), n)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        place = mix(mix(flat + mix(place * _ODD)) + leaf[line])
        place, line = place[flat > 0], line[flat > 0]
        often = _enough(place, line, lines)
        place, line = place[often], line[often]
        fixed = np.bincount(line, minlength=len(lines))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(place)])  # wraps around
        ends = np.cumsum(fixed)
        template = mix(total[ends] - total[ends - fixed] + leaf)
        able = np.flatnonzero(fixed >= t.constant * n)
        bad = lines.iloc[able[_enough(template[able], able, lines)]]
        return pa.table({"leaf": pa.array(bad.leaf, pa.int64()), "whole": pa.array(bad.whole, pa.int64())})

    return find


def _recurring(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys that lines of `need` different texts have: one row per text of a line that fewer texts have, one row
    without content for any other."""
    content = F.when(F.col("texts") < F.col("need"), F.array_distinct(F.array("first", "last")))
    once = lines.withColumn("content", F.explode_outer(content)).groupBy(*keys, "need", "content").agg(F.max("texts").alias("texts"))
    once = once.groupBy(*keys, "need").agg(F.max("texts").alias("texts"), F.count("content").alias("all"))
    return once.where("texts >= need or all >= need").select(*keys).distinct()


def _spread(lines: DataFrame, t: Tree) -> DataFrame:
    """The lines of leaves of any size whose templates recur: what _templates does, token by token in Spark. Both sides of
    its joins are written first, so that joins on a token or a template of very many lines can be split."""
    each = lines.select("leaf", "whole", "n", "texts", "need", "first", "last", F.posexplode("tokens").alias("i", "token"))
    each = each.where("token <> 0").withColumn("place", F.xxhash64("leaf", "i", "token")).drop("i", "token")
    often = cut(_recurring(each, "place"))
    one = each.join(small(often), "place", "left_semi").groupBy("leaf", "whole", "n", "texts", "need", "first", "last")
    one = one.agg(F.sum(F.col("place").cast("decimal(20,0)")).alias("template"), F.count("*").alias("fixed"))
    one = cut(one.where(F.col("fixed") >= t.constant * F.col("n")))
    return one.join(small(cut(_recurring(one, "leaf", "template"))), ["leaf", "template"], "left_semi").select("leaf", "whole")


def recurring_lines(docs: DataFrame, t: Tree = Tree()) -> DataFrame:
    """(doc_id, rowkey, n_lines, n_dropped, dropped): one row per row of docs; dropped lists line numbers from 0.

    A line's tokens are its `[^\\x20\\x09-\\x0D]+`; lines end at line feeds. Null and empty texts have no lines, and
    lines without tokens are never dropped. Texts that are copies of each other count as one, so a line must recur in
    different texts; a line that is just often enough is dropped everywhere, there is no choice among equals. doc_id may
    be of any type. Other columns are ignored; rows that repeat get equal results.

    Method: a line goes down the tree by its number of tokens and its leading tokens, tokens with a digit being variable.
    Within a leaf, a token that fewer texts than a template needs have at its position is variable as well. Lines with
    the same constant tokens at the same positions are of one template. A text counts once, however many lines of a
    template it has, and lines that are equal down to their digits need no constant tokens. Equal lines are counted before
    anything else is done with them, so a line of a third of all texts is one row, and only lines that share a leaf with
    different lines are taken apart: a bitmap of fixed size tells which. Leaves of up to t.lines different lines go whole
    to a task, many at a time; those of larger ones are counted token by token over all tasks. Tokens are told apart
    by 32 bits at a position of a leaf, lines and texts by 64.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", row_hash("doc_id").alias("rowkey"), content.alias("content"), _mapped(t)(F.col("text")).alias("s"))
    rows = cut(rows.select("doc_id", "rowkey", "content", "s.n_lines", "s.lines"))
    found = rows.select("doc_id", "rowkey", "content", F.explode("lines").alias("l")).select("doc_id", "rowkey", "content", "l.*")

    # one row per different line, with the number of texts that have it; then leaves that different lines share
    need = F.when(F.col("n") >= t.long, 2).otherwise(t.docs).cast("long")
    lines = found.select("leaf", "whole", "n", "plain", "content").distinct().groupBy("leaf", "whole", "n", "plain")
    lines = cut(lines.agg(F.count("*").alias("texts"), F.min("content").alias("first"), F.max("content").alias("last")))
    mixed = lines.groupBy("leaf", "n").agg(F.count("*").alias("lines"), F.sum("texts").alias("all"), F.sum("n").alias("tokens"))
    mixed = cut(mixed.where((F.col("lines") > 1) & (F.col("all") >= need)).select("leaf", (F.col("lines") > t.lines).alias("large"), "tokens"))
    leaves = spark.sparkContext.broadcast(sketch(mixed, F.col("leaf"), t.sketch_bits))
    parts = docs.select(F.explode(_opened(t, leaves)(F.col("text"))).alias("l")).select("l.*").groupBy("leaf", "whole").agg(F.first("tokens").alias("tokens"))
    shared = lines.join(mixed.select("leaf", "large"), "leaf").select("leaf", "whole", "n", need.alias("need"), "texts", "first", "last", "large")
    parts = parts.join(shared, ["leaf", "whole"])
    tokens, large = mixed.agg(F.coalesce(F.sum(F.when(~F.col("large"), F.col("tokens"))), F.lit(0)), F.max("large")).first()
    if large:
        parts = cut(parts)
    bucket = F.pmod(F.xxhash64("leaf"), F.lit(tokens // t.tokens + 1)).alias("bucket")
    whole = parts.where("not large").select("leaf", "whole", "n", "need", "texts", "first", "last", "tokens", bucket)
    general = whole.groupBy("bucket").applyInArrow(_templates(t), "leaf long, whole long")
    if large:
        general = general.union(_spread(parts.where("large"), t))
    equal = lines.where((F.col("texts") >= need) & (F.col("plain") >= t.constant * F.col("n")))
    bad = equal.select("leaf", "whole").union(general).distinct()
    # lines with digits, as they are
    numbers = found.where("plain < n")
    same = cut(numbers.select("exact", "n", "content").distinct().groupBy("exact", "n").agg(F.count("*").alias("texts")).where(F.col("texts") >= need).select("exact"))
    dropped = found.select("doc_id", "rowkey", "line", "leaf", "whole").join(small(cut(bad)), ["leaf", "whole"], "left_semi").drop("leaf", "whole")
    dropped = dropped.union(numbers.select("doc_id", "rowkey", "line", "exact").join(small(same), "exact", "left_semi").drop("exact"))
    dropped = dropped.groupBy("doc_id", "rowkey").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    d = dropped.select(F.col("doc_id").alias("d_id"), F.col("rowkey").alias("d_row"), "dropped")
    out = rows.drop("lines", "content").join(d, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("rowkey") == F.col("d_row")), "left")
    empty = F.array().cast("array<bigint>")
    return out.select("doc_id", "rowkey", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", empty).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, t: Tree = Tree()) -> DataFrame:
    """docs with recurring lines cut out of text, and n_dropped added (an old column of that name is replaced)."""
    docs = without(docs, "n_dropped", "_row", "_dropped")
    found = recurring_lines(docs, t).where("n_dropped > 0").select(F.col("doc_id").alias("_id"), F.col("rowkey").alias("_key"), F.col("dropped").alias("_dropped")).distinct()
    found = cut(found)
    side = F.broadcast if found.count() <= BROADCAST_ROWS // 10 else (lambda df: df)
    out = docs.join(side(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (row_hash("doc_id") == F.col("_key")), "left")
    numbered = F.split("text", "\n", -1)
    kept = F.filter(numbered, lambda x, i: ~F.array_contains(F.col("_dropped"), i.cast("long")))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
