"""N-gram Jaccard join with a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftgraph.llm.common import CHUNK, WORD_BYTES, bounded_batches, components, cut, grams, hashed_words, keep_rows, mix, row_hash, sketch, small


@dataclass(frozen=True)
class Forest:
    """trees prefix tries of labels of depth minima, eight bits each. Matched prefixes are shortened from depth until
    `recall` of the links are found by the estimate of `jaccard_join`, at most down to `floor`.

    Exact verification takes blocks of `tile` texts or `tile_bytes` of shingles, whichever is less.
    """

    words: int = 5
    threshold: float = 0.8
    trees: int = 32
    depth: int = 8
    recall: float = 0.9999
    tile: int = 256
    tile_bytes: int = 16 << 20
    sketch_bits: int = 25
    seed: int = 11

    def found(self, s, d: int):
        """The chance that texts of similarity s share a prefix of d minima in some trie."""
        return 1 - (1 - s**d) ** self.trees

    @property
    def floor(self) -> int:
        """The longest prefix by which a pair just at the threshold is found with the target recall."""
        return next((d for d in range(self.depth, 1, -1) if self.found(self.threshold, d) >= self.recall), 1)

    @property
    def levels(self) -> range:
        return range(self.depth, self.floor - 1, -1)


def shingles(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words, sorted within each text, and where each text's end.

    A text with fewer words, but not none, has all of them as its one shingle.
    """
    begins = np.concatenate([[0], ends[:-1]])
    n = ends - begins
    text = np.repeat(np.arange(len(ends)), n)
    g = grams(h, k)
    ok = np.arange(len(g)) + k <= (ends[text[: len(g)]] if len(g) else 0)
    g, t = g[ok], text[: len(g)][ok]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        g = np.concatenate([g, [grams(h[begins[i] : ends[i]], int(n[i]))[0] for i in few]]).astype(np.uint64)
        t = np.concatenate([t, few])
    order = np.lexsort((g, t))
    g, t = g[order], t[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    return g[new], np.searchsorted(t[new], np.arange(len(ends)), "right")


def _sums(x: np.ndarray, begins: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begins), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(x, begins[full])
    return out


def fingerprints(g: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set of shingles, null for an empty one."""
    begins = np.concatenate([[0], ends[:-1]])
    full = ends > begins
    a = _sums(mix(g ^ np.uint64(0xA5A5A5A5)), begins, full)
    b = _sums(mix(g + np.uint64(0x5DEECE66D)), begins, full) * np.uint64(0x9E3779B97F4A7C15) + (ends - begins).astype(np.uint64)
    both = np.stack([a, b], axis=1).tobytes()
    return [both[16 * i : 16 * i + 16] if f else None for i, f in enumerate(full)]


def labels(g: np.ndarray, ends: np.ndarray, f: Forest) -> np.ndarray:
    """For each text and trie, its label: eight bits of each of `depth` minima of permuted shingles, the first one topmost."""
    begins = np.concatenate([[0], ends[:-1]])
    rng = np.random.default_rng(f.seed)
    seeds = rng.integers(1, 2**32, (f.trees, f.depth, 2), dtype=np.uint64).astype(np.uint32)
    x = (g >> np.uint64(32)).astype(np.uint32) ^ g.astype(np.uint32)
    full = ends > begins
    out = np.zeros((len(ends), f.trees), np.uint64)
    if not full.any():
        return out
    at = begins[full]
    for t in range(f.trees):
        for j in range(f.depth):
            y = (x ^ seeds[t, j, 0]) * (seeds[t, j, 1] | np.uint32(1))
            y ^= y >> np.uint32(15)
            least = (np.minimum.reduceat(y, at) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            out[full, t] |= least.astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _signer(f: Forest):
    kind = pa.struct([("fp", pa.binary()), ("size", pa.int32()), ("labels", pa.list_(pa.int64()))])

    @arrow_udf("struct<fp:binary,size:int,labels:array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        fps, sizes, keys = [], [], []
        for _, _, h, ends in hashed_words(texts, WORD_BYTES, CHUNK):
            g, stop = shingles(h, ends, f.words)
            fps += fingerprints(g, stop)
            sizes.append(np.diff(stop, prepend=0))
            keys.append(labels(g, stop, f).view(np.int64))
        keys = np.concatenate(keys) if keys else np.empty((0, f.trees), np.int64)
        sizes = np.concatenate(sizes) if sizes else np.empty(0)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, f.trees, dtype=np.int32)), pa.array(keys.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), pa.array(sizes.astype(np.int32)), flat], fields=list(kind))

    return sign


_TIES = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("d", pa.int32()), ("pid", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("b2", pa.binary())])


def _trie(f: Forest):
    """Over rows (tree, label, fp) sorted by tree and label: the branches of the tries, from the leaves up.

    The rows below a branch follow each other; a branch is named by the least fp below it. A tie (a, b, d) says that the
    branch a joins others in b at depth d. A partition's first and last branches may go on in its neighbours: rows
    with pid tell their keys and names at each depth.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        first: dict[int, tuple] = {}
        last: dict[int, tuple] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, label = (np.asarray(batch.column(c)).astype(np.int64).view(np.uint64) for c in ("tree", "label"))
            fp = batch.column("fp").cast(pa.binary(16))
            below = np.frombuffer(fp.buffers()[1], ">u8")[2 * fp.offset : 2 * (fp.offset + len(fp))].reshape(-1, 2).astype(np.uint64)
            begins = np.ones(len(below), bool)
            ties = []
            for d in f.levels:
                key = mix((label >> np.uint64(64 - 8 * d)) + mix(tree + np.uint64(1)))
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                run = np.cumsum(new) - 1
                order = np.lexsort((below[:, 1], below[:, 0], run))
                name = below[order[np.flatnonzero(new)]]
                if d in last and last[d][0] == key[0]:
                    name[0] = last[d][1]
                own = name[run]
                tied = np.flatnonzero(begins & (below != own).any(axis=1))
                ties.append((below[tied], own[tied], np.full(len(tied), d, np.int32)))
                first.setdefault(d, (key[0], name[0]))
                last[d] = (key[-1], name[-1])
                below, begins = own, new
            a, b, d = (np.concatenate(x) for x in zip(*ties, strict=True))
            yield from pa.Table.from_arrays([_binary(a), _binary(b), pa.array(d), *(pa.nulls(len(d), _TIES.field(c).type) for c in ("pid", "k1", "k2", "b2"))], schema=_TIES).to_batches()
        if first:
            rows = [(_bytes(first[d][1]), d, int(first[d][0].view(np.int64)), int(last[d][0].view(np.int64)), _bytes(last[d][1])) for d in f.levels]
            b, d, k1, k2, b2 = zip(*rows, strict=True)
            yield pa.record_batch([pa.nulls(len(d), pa.binary()), pa.array(b, pa.binary()), pa.array(d, pa.int32()), pa.array([pid] * len(d), pa.int32()), pa.array(k1), pa.array(k2), pa.array(b2, pa.binary())], schema=_TIES)

    return scan


def _bytes(pair: np.ndarray) -> bytes:
    return pair.astype(">u8").tobytes()


def _binary(pairs: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(_bytes(pairs))]).cast(pa.binary())


def tries(nodes: DataFrame, f: Forest) -> DataFrame:
    """(a, b, d): which branches of the tries of nodes (fp, labels) join at which depth. One sort serves all depths, and
    a branch with very many nodes below it lies in as many partitions as it fills."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())
    leaves = nodes.select("fp", F.posexplode("labels").alias("tree", "label"))
    leaves = leaves.repartitionByRange(parts, "tree", "label", "fp").sortWithinPartitions("tree", "label")
    found = cut(leaves.select("tree", "label", "fp").mapInArrow(_trie(f), "a binary, b binary, d int, pid int, k1 long, k2 long, b2 binary"))
    before = Window.partitionBy("d").orderBy("pid")  # one row a partition
    edges = found.where("pid is not null").select("d", "k1", "b", F.lag("k2").over(before).alias("k2"), F.lag("b2").over(before).alias("b2"))
    edges = edges.where("k1 = k2 and b <> b2").select("b", "b2", "d")
    return cut(found.where("pid is null").select("a", "b", "d").union(edges).groupBy("a", "b").agg(F.max("d").alias("d")))


def _opener(f: Forest, bitmap):
    """Shingles of the texts whose fingerprint the bitmap has."""
    kind = pa.struct([("fp", pa.binary()), ("shingles", pa.binary())])

    @arrow_udf("struct<fp:binary,shingles:binary>")
    def open_(texts: pa.Array) -> pa.Array:
        wanted = bitmap.value
        fps, sets = [], []
        for _, _, h, ends in hashed_words(texts, WORD_BYTES, CHUNK):
            g, stop = shingles(h, ends, f.words)
            begin = 0
            for p, end in zip(fingerprints(g, stop), stop.tolist(), strict=True):
                bit = None if p is None else int.from_bytes(p[:8], "little") & ((1 << f.sketch_bits) - 1)
                fps.append(p)
                sets.append(g[begin:end].tobytes() if bit is not None and wanted[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1) else None)
                begin = end
        return pa.StructArray.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], fields=list(kind))

    return open_


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b, by a product of incidence matrices."""
    x, y = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(sets, flat):
        i = np.searchsorted(common, flat)
        i[i == len(common)] = 0
        ok = common[i] == flat if len(common) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], i[ok]

    (ra, ca), (rb, cb) = places(a, x), places(b, y)
    for lo in range(0, len(common), 8192):
        m, k = np.zeros((len(a), 8192), np.float32), np.zeros((len(b), 8192), np.float32)
        p, q = (ca >= lo) & (ca < lo + 8192), (cb >= lo) & (cb < lo + 8192)
        m[ra[p], ca[p] - lo] = 1
        k[rb[q], cb[q] - lo] = 1
        out += m @ k.T
    return out


_LINKS = "root binary, fp binary, link binary, links long, pairs double, missed array<double>"


def _verify(f: Forest):
    """Exact verification of one tile: links of each text to texts of the other block, one tie of each linked text, and
    on one row for each depth how many such pairs are likely to be missed for each that is found."""

    def tile(batch: pa.Table) -> pa.Table:
        root, i, j = (batch.column(c)[0].as_py() for c in ("root", "i", "j"))
        fps = batch.column("fp").to_pylist()
        blocks = batch.column("block").to_pylist()
        rows = batch.column("rows").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        order = sorted(range(len(fps)), key=fps.__getitem__)
        left, right = [x for x in order if blocks[x] == i], [x for x in order if blocks[x] == j]
        out: dict[int, list] = {}
        pairs, missed = 0.0, [0.0] * len(f.levels)
        if left and right:
            got = overlaps([sets[x] for x in left], [sets[x] for x in right])
            na, nb = (np.array([len(sets[x]) for x in side], np.float64) for side in (left, right))
            linked = got >= f.threshold * (na[:, None] + nb[None, :] - got) - 1e-6
            if i == j:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            s = got[a, b] / (na[a] + nb[b] - got[a, b])
            once = 0.5 if i == j else 1.0
            pairs, missed = once * len(s), [once * float((1 / f.found(s, d) - 1).sum()) for d in f.levels]
            w = np.array([rows[x] for x in right], np.int64)
            v = np.array([rows[x] for x in left], np.int64)
            for side, other, m, weight in ((left, right, linked, w), (right, left, linked.T, v))[: 1 if i == j else 2]:
                n = m @ weight
                for a in np.flatnonzero(m.any(axis=1)):
                    out[side[a]] = [fps[other[int(np.argmax(m[a]))]], int(n[a])]
            # a text may be tied to another than its block's first: ties follow a spanning forest of the tile
            for a, tie in _forest(linked, left, right):
                out.setdefault((a, tie), [fps[tie], 0])
        picked = [(root, fps[k if isinstance(k, int) else k[0]], *v, 0.0, None) for k, v in out.items()] + [(root, None, None, 0, pairs, missed)]
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*picked, strict=True), kinds, strict=True)], names=["root", "fp", "link", "links", "pairs", "missed"])

    return tile


def _forest(linked: np.ndarray, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """Ties that connect all that the tile's links connect, at most one a text."""
    free = set(left) | set(right)
    place = {x: a for a, x in enumerate(left)}, {x: b for b, x in enumerate(right)}
    while free:
        todo = [free.pop()]
        while todo:
            x = todo.pop()
            near = []
            if x in place[0]:
                near += [right[b] for b in np.flatnonzero(linked[place[0][x]])]
            if x in place[1]:
                near += [left[a] for a in np.flatnonzero(linked[:, place[1][x]])]
            for y in near:
                if y in free:
                    free.discard(y)
                    todo.append(y)
                    yield y, x


def _joined(family: DataFrame, ties: DataFrame, n: int) -> DataFrame:
    """(node, root) after ties (a, b) join families: the roots alone are searched for components."""
    root = family.select(F.col("node").alias("x"), F.col("root").alias("r"))
    ends = ties.select("a", "b").join(root.withColumnRenamed("r", "ra"), F.col("a") == F.col("x")).drop("x", "a")
    ends = ends.join(root.withColumnRenamed("r", "rb"), F.col("b") == F.col("x")).select("ra", "rb")
    moved = cut(components(ends, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("to")), n)
    return cut(family.join(small(moved), "root", "left").select("node", F.coalesce("to", "root").alias("root")), n)


def _verified(family: DataFrame, sizes: DataFrame, sets: DataFrame, f: Forest) -> DataFrame:
    """Links within the families of sizes. A family of m blocks is verified in m * (m + 1) / 2 tiles."""
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(f.tile)), F.ceil(F.col("size") * 8 / F.lit(f.tile_bytes))).cast("int")
    placed = family.join(small(sizes.select("root", blocks.alias("blocks"))), "root")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = placed.join(sets.drop("size"), placed.node == sets.fp).drop("node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = full.select("*", other.alias("o")).select("root", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "fp", "rows", "shingles")
    return tiles.groupBy("root", "i", "j").applyInArrow(_verify(f), _LINKS)


def jaccard_join(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """(doc_id, rowkey, class_id, class_size, n_links, kept): one row per row of docs.

    Documents are linked when the sets of their runs of five words (all words, if fewer) have a Jaccard similarity of at
    least f.threshold. n_links counts a document's partners, copies of the same set included; class_id is the
    smallest doc_id of those connected by links, kept marks the row that represents the class: the one of
    class_id, by row hash among rows that repeat it (all of them, if they repeat the text too). Null, empty and
    wordless texts have no shingles and no links; each is a class of its own with its doc_id. A null doc_id
    counts as the largest. Other columns are ignored. An empty table gives an empty result.

    Method: documents with the same set are one node. Each node has a label in each trie; the labels are sorted, so that
    those which share a prefix follow each other. Matching begins with whole labels: connected matches form families, which
    are verified exactly in tiles of two blocks of nodes; a tile gives counts and a spanning forest, never its pairs.
    A link of similarity s is found at depth d with a chance that is known, so each link found stands for
    some that were missed; if these are more than the target recall allows, prefixes are shortened to the longest at
    which they are not, and the families that grow are verified anew, until the links then found agree. At f.floor any pair
    at the threshold itself meets with that recall. Only sets of candidates are shuffled: a bitmap of fixed size tells the others apart.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    sign = _signer(f)
    rows = docs.select("doc_id", row_hash("doc_id").alias("rowkey"), sign(F.col("text")).alias("s"))
    rows = cut(rows.select("doc_id", "rowkey", "s.fp", "s.size", "s.labels"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("rowkey").alias("row")))
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("rows"), F.first("size").alias("size"), first.alias("first"), F.first("labels").alias("labels"))
    nodes = cut(nodes)
    rows = rows.select("doc_id", "rowkey", "fp")
    ties = tries(nodes.select("fp", "labels"), f)
    nodes = nodes.drop("labels")
    near = ties.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    near = cut(nodes.join(near, "fp", "left_semi").select("fp", "rows", "size", "first"))
    bitmap = spark.sparkContext.broadcast(sketch(near, first_bytes(F.col("fp")), f.sketch_bits))
    sets = docs.select(_opener(f, bitmap)(F.col("text")).alias("s")).select("s.*").where("shingles is not null")
    sets = cut(sets.groupBy("fp").agg(F.first("shingles").alias("shingles")).join(near.select("fp", "rows", "size"), "fp"))

    family = near.select(F.col("fp").alias("node"), F.col("fp").alias("root"))
    n = near.count()
    d, upto, known, links = f.depth, f.depth + 1, None, None
    while True:
        family = _joined(family, ties.where((F.col("d") >= d) & (F.col("d") < upto)), n)
        sizes = family.join(sets.select(F.col("fp").alias("node"), "size"), "node").groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("size"))
        sizes = cut(sizes.where("members > 1"), n)
        grown = sizes if known is None else sizes.join(known, ["root", "members"], "left_anti")
        more = _verified(family, grown, sets, f)
        if links is not None:
            same = cut(sizes.join(known, ["root", "members"], "left_semi").select("root"), n)
            more = more.unionByName(links.join(small(same), "root", "left_semi"))
        links, known = cut(more), sizes.select("root", "members")
        pairs, *missed = links.agg(F.sum("pairs"), *[F.sum(F.element_at("missed", i + 1)) for i in range(len(f.levels))]).first()
        enough = [x for x, m in zip(f.levels, missed, strict=True) if pairs and pairs >= f.recall * (pairs + m)]
        if d == f.floor or enough and enough[0] == d:
            break
        d, upto = (enough[0] if enough else f.floor), d
    links = links.where("fp is not null")

    counts = links.groupBy("fp").agg(F.sum("links").alias("links"))
    roots = cut(components(links.select(F.col("fp").alias("a"), F.col("link").alias("b"))).withColumnRenamed("node", "fp"), n)
    classes = roots.join(near, "fp").groupBy("root").agg(F.min("first").alias("lead"), F.sum("rows").alias("class_size"))
    linked = roots.join(small(cut(classes, n)), "root").join(counts, "fp").select("fp", "lead", "class_size", "links")
    per_node = nodes.join(linked, "fp", "left").select("fp", F.coalesce("lead", "first").alias("lead"), F.coalesce("class_size", "rows").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = rows.join(cut(per_node), "fp", "left")
    kept = F.col("fp").isNull() | (F.col("doc_id").eqNullSafe(F.col("lead.id")) & (F.col("rowkey") == F.col("lead.row")))
    return out.select("doc_id", "rowkey", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("lead.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), kept.alias("kept"))


def first_bytes(fp: Column) -> Column:
    """The first four bytes of a fingerprint as a number, the last one first."""
    h = F.hex(fp)
    return F.conv(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("long")


def near_dedup(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """The rows of docs that represent their class, with the columns of docs."""
    return keep_rows(docs, jaccard_join(docs, f))
