"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftgraph.llm.common import CHUNK, WORD_BYTES, bounded_batches, cut, grams, hashed_words, without

_NONE = np.uint64(2**64 - 1)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of w consecutive hashes; _NONE never counts."""
    n = len(g)
    if not n:
        return np.empty(0, np.int64)
    wide = np.concatenate([np.full(w - 1, _NONE), g, np.full(w - 1, _NONE)])
    least = np.lib.stride_tricks.sliding_window_view(wide, w).min(axis=1) if n < 64 else _slide(wide, w, np.minimum)
    # windows inside the sequence only: those that begin at w-1 .. w-1+n-w (one cut-off window if n < w)
    inside = np.zeros(len(least), np.uint64)
    lo, hi = (w - 1, n) if n >= w else (0, len(least))
    inside[lo:hi] = least[lo:hi]
    top = _slide(inside, w, np.maximum)
    return np.flatnonzero((top[:n] == g) & (g != _NONE))


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    out = x[: len(x) - w + 1].copy()
    for j in range(1, w):
        f(out, x[j : len(x) - w + 1 + j], out=out)
    return out


class Items:
    """Word sequences of a block of benchmark items, with the fingerprints of their k-grams.

    Sequences of `window` words and over share a fingerprint with every text that has `window` of their
    words in a row, as each run of window - k + 1 k-grams gives its least hash. Shorter sequences are
    single grams of their own length.
    """

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int, k: int):
        self.window, self.k = window, k
        names: dict[bytes, set[str]] = defaultdict(set)
        words: dict[bytes, np.ndarray] = {}
        ids, texts = zip(*items, strict=True) if items else ((), ())
        for lo, hi, h, ends in hashed_words(pa.array(texts, pa.string()), WORD_BYTES):
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True), lo):
                if b > a:
                    key = h[a:b].tobytes()
                    words[key] = h[a:b]
                    names[key] |= set() if ids[i] is None else {str(ids[i])}
        self.names = [sorted(names[x]) for x in words]
        seqs = list(words.values())
        blank = np.zeros(1, np.uint64)
        long = [i for i, s in enumerate(seqs) if len(s) >= window]
        self.text = np.concatenate([blank, *(y for i in long for y in (seqs[i], blank))])
        self.owner = np.concatenate([[-1], *(np.full(len(seqs[i]) + 1, i) for i in long)]).astype(np.int64)
        at, pos, keys = 1, [], []
        for i in long:
            g = grams(seqs[i], k)
            p = winnow(g, window - k + 1)
            pos.append(p + at)
            keys.append(g[p])
            at += len(seqs[i]) + 1
        keys, pos = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (pos, np.int64)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.pos = keys[order], pos[order].astype(np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(s) for s in seqs if len(s) < window}):
            mine = [i for i, s in enumerate(seqs) if len(s) == n]
            g = np.array([grams(seqs[i], n)[0] for i in mine], np.uint64)
            order = np.argsort(g)
            self.short[n] = g[order], np.array(mine)[order]

    def hits(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts whose words end at `ends`: which words are hit, and the distinct (text, item) pairs."""
        n, covered = len(h), np.zeros(len(h) + 1, np.int32)
        begins = np.concatenate([[0], ends[:-1]])
        text = np.repeat(np.arange(len(ends)), ends - begins)
        end = ends[text] if n else text
        found = []
        if len(self.keys) and n >= self.k:
            g = grams(h, self.k)
            g[np.arange(len(g)) + self.k > end[: len(g)]] = _NONE
            p = winnow(g, self.window - self.k + 1)
            p = p[self.seen[(g[p] & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            lo, hi = np.searchsorted(self.keys, g[p], "left"), np.searchsorted(self.keys, g[p], "right")
            p, lo, times = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            q = self.pos[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            p = np.repeat(p, times)
            a, b, q = self._runs(h, begins[text[p]], end[p], p, q)
            long = b - a >= self.window
            spans = np.unique(np.stack([a[long], b[long], self.owner[q[long]]], axis=1), axis=0) if long.any() else np.empty((0, 3), np.int64)
            np.add.at(covered, spans[:, 0], 1)
            np.add.at(covered, spans[:, 1], -1)
            found.append(np.stack([text[spans[:, 0]], spans[:, 2]], axis=1))
        for size, (keys, own) in self.short.items():
            if n < size:
                continue
            g = grams(h, size)
            i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            p = np.flatnonzero((keys[i] == g) & (np.arange(len(g)) + size <= end[: len(g)]))
            np.add.at(covered, p, 1)
            np.add.at(covered, p + size, -1)
            found.append(np.stack([text[p], own[i[p]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return np.cumsum(covered[:n]) > 0, pairs

    def _runs(self, h, first, end, p, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the longest runs of equal words around the hits (p, q), and a place of each in the items.

        A run has a hit in each of its windows, so hits of one run follow each other at less than a window's distance
        on the same diagonal: only words between neighbours and beyond a run's first and last hit are compared.
        """
        # the k-gram itself is compared word by word: equal hashes are no proof
        same = np.ones(len(p), bool)
        for j in range(self.k):
            same &= h[p + j] == self.text[q + j]
        order = np.flatnonzero(same)[np.lexsort((p[same], (p - q)[same]))]
        p, q, first, end = p[order], q[order], first[order], end[order]
        gap = np.diff(p)
        linked = (np.diff(p - q) == 0) & (gap <= self.window) & (p[1:] + self.k <= end[:-1])
        for j in range(self.k, self.window):
            go = np.flatnonzero(linked & (gap > j))
            linked[go] = h[p[go] + j] == self.text[q[go] + j]
        head = np.flatnonzero(np.concatenate([[True], ~linked])[: len(p)])
        tail = np.append(head[1:], len(p))[: len(head)] - 1
        a, x, low = p[head], q[head], first[head]
        b, y, high = p[tail] + self.k, q[tail] + self.k, end[tail]
        go = np.arange(len(head))
        while len(go):
            go = go[a[go] > low[go]]
            go = go[h[a[go] - 1] == self.text[x[go] - 1]]
            a[go] -= 1
            x[go] -= 1
        go = np.arange(len(head))
        while len(go):
            go = go[b[go] < high[go]]
            go = go[h[b[go]] == self.text[y[go]]]
            b[go] += 1
            y[go] += 1
        return a, b, q[head]


_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit", pa.binary())])


def _scanner(shared, carry: bool):
    """carry: bits of the words hit go in and out, so that blocks of items add up."""

    def scan(texts: pa.Array, before: pa.Array | None) -> pa.Array:
        items: Items = shared.value
        words, hit, names, bits = [], [], [], []
        for lo, hi, h, ends in hashed_words(texts, WORD_BYTES, CHUNK):
            covered, pairs = items.hits(h, ends)
            begins = np.concatenate([[0], ends[:-1]])
            own = [set() for _ in range(hi - lo)]
            for t, i in pairs.tolist():
                own[t].update(items.names[i])
            for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
                mine = covered[a:b]
                if before is not None and before[lo + i].is_valid:
                    old = before[lo + i]
                    mine = mine | np.unpackbits(np.frombuffer(old["hit"].as_py(), np.uint8), count=b - a).astype(bool)
                    own[i].update(old["items"].as_py())
                words.append(b - a)
                hit.append(int(mine.sum()))
                names.append(sorted(own[i]))
                bits.append(np.packbits(mine).tobytes() if carry else b"")
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(bits, pa.binary())], fields=list(_FOUND))

    kind = "struct<n_words:long,n_hit:long,items:array<string>,hit:binary>"
    if carry:

        @arrow_udf(kind)
        def more(texts: pa.Array, before: pa.Array) -> pa.Array:
            return scan(texts, before)

        return lambda text, before: more(text, before)

    @arrow_udf(kind)
    def once(texts: pa.Array) -> pa.Array:
        return scan(texts, None)

    return lambda text, _: once(text)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, block_chars: int = 50_000_000) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (ids as sorted strings) and contaminated added.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. A word is hit if it lies in an
    occurrence of a window: `window` consecutive words of an item, or all words of a shorter item. Null or
    empty texts have no words: such a document is clean, such an item hits nothing. Items with equal ids are
    one item; an item whose id is null hits words but is neither listed nor counted. Columns of docs with the names
    of the added ones are replaced; all other columns and repeated rows stay as they are.

    Method: both sides are winnowed (least k-gram hash of each window - k + 1), fingerprints joined, and each hit
    extended over equal words. Items go to the executors in blocks of at most about block_chars characters; more
    items mean more passes over the texts, each adding to the words hit so far. An item longer than a block makes a block of its own.
    """
    assert 0 < k <= window
    spark = docs.sparkSession
    bounded_batches(docs)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    names = ("n_words", "n_hit", "n_items", "items", "contaminated", "_found")
    out = without(docs, *names)
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == i)
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in part.collect()], window, k))
        scan = _scanner(shared, blocks > 1)
        out = out.withColumn("_found", scan(F.col("text"), F.col("_found") if i else F.lit(None).cast("struct<n_words:long,n_hit:long,items:array<string>,hit:binary>")))
        if i + 1 < blocks:
            out = cut(out)
    kept = [F.col(f"`{c}`") for c in out.columns if c != "_found"]
    return out.select(*kept, "_found.n_words", "_found.n_hit", F.size("_found.items").cast("long").alias("n_items"), "_found.items", (F.col("_found.n_hit") > 0).alias("contaminated"))
