"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftgraph.llm.common import CHUNK, TOKEN_BYTES, bounded_batches, cut, hash_words, held_in, pieces

#: The hash of the token that ends a text.
END = np.uint64(2)


@dataclass(frozen=True)
class Model:
    """Tokens that occur `least` times have a vector of their own, so their number follows from the corpus; `words` bounds it,
    as vectors go to every executor. All others share vectors of `classes` classes by their last bytes.

    `common` tokens have their counts sent to every executor; the counts of all others are joined by shuffle. Texts are
    dealt by their hash to one learner for each `share` tokens, `learners` at most, each of which sees its texts once;
    warm_chars bounds the sample that all of them start from.
    """

    words: int = 20_000
    least: int = 50
    classes: int = 64
    dim: int = 16
    noise: int = 24
    batch: int = 2048
    rate: float = 0.05
    common: int = 300_000
    share: int = 2_000_000
    learners: int = 2_000
    warm_docs: int = 2_000
    warm_chars: int = 6_000_000
    seed: int = 5


# ---------------------------------------------------------------- tokens


def tokens(texts: pa.Array, classes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, end, hashes, classes, ends) for runs of texts; each text's tokens are followed by its end."""
    for lo, hi, h, stop, last in _tails(texts):
        n = len(h) + hi - lo
        place = stop + np.arange(hi - lo)  # of the ends of texts
        word = np.ones(n, bool)
        word[place] = False
        out, cls = np.full(n, END), np.zeros(n, np.int64)
        out[word] = h
        cls[word] = last % classes
        yield lo, hi, out, cls, place + 1


def _tails(texts: pa.Array):
    """Hashed words with a number made of each word's last two bytes. Long runs are taken part by part."""
    for lo, hi, data, at in pieces(texts, TOKEN_BYTES, CHUNK):
        hashes, starts, tails, here = [], [], [], 0
        while here < len(data):
            stop = len(data) if len(data) <= here + 2 * CHUNK else data.find(b" ", here + CHUNK) + 1
            part = data[here:stop]
            b = np.frombuffer(part, np.uint8)
            ends = np.flatnonzero((b[:-1] != 32) & (b[1:] == 32))
            tails.append(b[ends].astype(np.int64) * 31 + np.where(ends > 0, b[np.maximum(ends - 1, 0)], 32))
            first, h = hash_words(part)
            hashes.append(h)
            starts.append(first + here)
            here = stop
        yield lo, hi, np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at[1:]), np.concatenate(tails)


def token_counts(docs: DataFrame, m: Model) -> DataFrame:
    """(token, cls, n) over all texts of docs, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, cls, _ in tokens(batch.column(0), m.classes):
                t, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(t.view(np.int64)), pa.array(cls[first]), pa.array(n.astype(np.int64))], names=["token", "cls", "n"])

    return docs.select("text").mapInArrow(count, "token long, cls long, n long").groupBy("token").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))


class Vocabulary:
    """Counts of the most common tokens, and each token's number in the model: words first, then classes."""

    def __init__(self, token: np.ndarray, n: np.ndarray, m: Model):
        """token, n: by falling count; the end comes first."""
        self.words = min(m.words, int((n >= m.least).sum()) if len(n) else 0)
        order = np.argsort(token)
        self.token, self.n = token[order], n[order]
        number = np.full(len(token), -1, np.int32)
        number[: self.words] = np.arange(self.words)
        self.number = number[order]

    def look_up(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the model, and counts (-1: not among the common ones)."""
        if not len(self.token):
            return self.words + cls, np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.token, h), len(self.token) - 1)
        hit = self.token[at] == h
        number = np.where(hit, self.number[at], -1)
        return np.where(number < 0, self.words + cls, number), np.where(hit, self.n[at], -1)


# ---------------------------------------------------------------- training


class Groups:
    """Groups of numbers in the model, of about equal shares of the tokens and about the square root of them in number:
    a probability is that of the group times that within it, so a token costs no sum over the whole vocabulary."""

    def __init__(self, share: np.ndarray):
        by_share = np.argsort(-share, kind="stable")
        before = np.cumsum(share[by_share]) - share[by_share]
        _, group = np.unique((before / share.sum() * math.isqrt(len(share))).astype(np.int64), return_inverse=True)
        self.of = np.empty(len(share), np.int64)
        self.of[by_share] = group
        self.members = np.split(by_share, np.flatnonzero(np.diff(group)) + 1)
        self.place = np.empty(len(share), np.int64)
        for x in self.members:
            self.place[x] = np.arange(len(x))
        self.share = np.bincount(self.of, share)


def start(m: Model, noise: np.ndarray, groups: Groups) -> list[np.ndarray]:
    """Context vectors, target vectors of numbers and of groups (the last column is a bias), and the matrices of the two places
    before a token."""
    rng = np.random.default_rng(m.seed)
    context = rng.normal(0, 0.1, (len(noise), m.dim))
    targets = [np.column_stack([rng.normal(0, 0.1, (len(x), m.dim)), np.log(x)]) for x in (noise, groups.share)]
    return [x.astype(np.float32) for x in (context, *targets, np.eye(m.dim), np.eye(m.dim))]


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers one and two places before each token; before a text they are those of an end."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    first = np.concatenate([[0], ends[:-1]])
    one[first] = 0
    two[first] = 0
    second = first + 1
    two[second[second < len(ids)]] = 0
    return one, two


class Trainer:
    """Noise-contrastive estimation of two targets from one context: the token's group, and the token."""

    def __init__(self, theta: list[np.ndarray], noise: np.ndarray, groups: Groups, m: Model):
        self.theta, self.m, self.group = [x.copy() for x in theta], m, groups.of
        self.sums = [np.full_like(x, 1e-6) for x in theta]
        self.log_noise = [np.log(x * m.noise).astype(np.float32) for x in (noise, groups.share)]
        self.cum = [np.cumsum(x) for x in (noise, groups.share)]
        self.rng = np.random.default_rng(m.seed)
        self.seen = 0

    def learn(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """One pass over a run of texts in shuffled batches. A batch's noise is shared by its tokens."""
        one, two = contexts(ids, ends)
        order = self.rng.permutation(len(ids))
        for lo in range(0, len(ids), self.m.batch):
            i = order[lo : lo + self.m.batch]
            self._step(one[i], two[i], ids[i])
        self.seen += len(ids)

    def _step(self, u: np.ndarray, v: np.ndarray, t: np.ndarray) -> None:
        r, _, _, c1, c2 = self.theta
        ru, rv = r.take(u, axis=0), r.take(v, axis=0)
        p = np.ones((len(t), r.shape[1] + 1), np.float32)
        p[:, :-1] = ru @ c1 + rv @ c2
        back = np.zeros_like(p)
        for k, target in ((1, t), (2, self.group[t])):
            q, log_noise, cum = self.theta[k], self.log_noise[k - 1], self.cum[k - 1]
            noise = np.minimum(np.searchsorted(cum, self.rng.random(self.m.noise) * cum[-1]), len(q) - 1)
            qt, qn = q.take(target, axis=0), q.take(noise, axis=0)
            up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", p, qt) - log_noise[target], -30, 30)))
            down = p @ qn.T
            down -= log_noise[noise]
            np.clip(down, -30, 30, out=down)
            np.negative(down, out=down)
            np.exp(down, out=down)
            down += 1
            np.reciprocal(down, out=down)
            qt *= up[:, None]
            qt -= down @ qn
            back += qt
            self._move(k, np.concatenate([target, noise]), np.concatenate([up[:, None] * p, -(down.T @ p)]), len(t))
        back = np.ascontiguousarray(back[:, :-1])
        moves = ru.T @ back, rv.T @ back
        self._move(0, np.concatenate([u, v]), np.concatenate([back @ c1.T, back @ c2.T]), len(t))
        for k, g in zip((3, 4), moves, strict=True):
            self._move(k, np.arange(len(g)), g, len(t))

    def _move(self, k: int, rows: np.ndarray, values: np.ndarray, n: int) -> None:
        """Add up the values of each row and take a step; rows that do not occur are not touched."""
        # sorts of 16-bit numbers are by their digits
        order = np.argsort(rows.astype(np.uint16) if len(self.theta[k]) <= 1 << 16 else rows, kind="stable")
        rows = rows.take(order)
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g = np.add.reduceat(values.take(order, axis=0), begins)
        g /= np.float32(n)
        rows = rows[begins]
        sums = self.sums[k].take(rows, axis=0)
        sums += g * g
        self.sums[k][rows] = sums
        g *= np.float32(self.m.rate)
        g /= np.sqrt(sums)
        self.theta[k][rows] += g


_BLOCK = 4096


def train(docs: DataFrame, vocabulary, noise: np.ndarray, groups: Groups, theta: list[np.ndarray], learners: int, m: Model) -> list[np.ndarray]:
    """Parameters after each learner has learned from all its texts, averaged by tokens seen. Texts go to learners, and
    come to them in turn, by their hashes, so that neither partitions nor reruns change what is learned."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((theta, noise, groups))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trainer(*shared.value, m)
        for texts in _runs(batches):
            for _, _, h, cls, ends in tokens(texts, m.classes):
                t.learn(vocabulary.value.look_up(h, cls)[0], ends)
        if t.seen:
            flat = np.concatenate([x.ravel() for x in t.theta])
            parts = [flat[i : i + _BLOCK].tobytes() for i in range(0, len(flat), _BLOCK)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([t.seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "seen", "part"])

    def average(group: pa.Table) -> pa.Table:
        group = group.sort_by([("seen", "ascending"), ("part", "ascending")])  # sums of floats depend on their order
        seen = np.array(group.column("seen").to_pylist(), np.float64)
        total = np.zeros(len(group.column("part")[0].as_py()) // 4)
        for k, part in zip(seen, group.column("part"), strict=True):
            total += k * np.frombuffer(part.as_py(), np.float32)
        return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary())], names=["block", "part"])

    # copies of a text go to different learners
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).repartition(learners, "h").sortWithinPartitions("h", "text")
    parts = dealt.select("text").mapInArrow(learn, "block int, seen long, part binary").groupBy("block").applyInArrow(average, "block int, part binary").collect()
    if not parts:
        return theta
    flat = np.concatenate([np.frombuffer(bytes(r.part), np.float32) for r in sorted(parts, key=lambda r: r.block)])
    out, at = [], 0
    for x in theta:
        out.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of all batches in runs of CHUNK bytes, wherever a batch ends."""
    held: list[str] = []
    size = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(text)
            size += len(text.encode())
            if size >= CHUNK:
                yield pa.array(held, pa.large_string())
                held, size = [], 0
    if held:
        yield pa.array(held, pa.large_string())


class Tables:
    """What each number adds to a prediction from one and two places before a token, and normalised probabilities."""

    def __init__(self, theta: list[np.ndarray], groups: Groups):
        r, self.q, self.gq, c1, c2 = (x.astype(np.float32) for x in theta)
        one = np.ones((len(r), 1), np.float32)
        self.one, self.two = np.concatenate([r @ c1, one], axis=1), np.concatenate([r @ c2, 0 * one], axis=1)
        self.groups = groups
        self.words = [self.q[x].T for x in groups.members]
        self.gq = self.gq.T

    def log10(self, one: np.ndarray, two: np.ndarray, t: np.ndarray, block: int = 32768) -> np.ndarray:
        """The base-10 log-probability of t after the numbers `one` and `two` places before it."""
        out = np.empty(len(t))
        for lo in range(0, len(t), block):
            p = self.one[one[lo : lo + block]] + self.two[two[lo : lo + block]]
            here = t[lo : lo + block]
            group = self.groups.of[here]
            logs = _log_share(p, self.gq, group)
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.diff(group[order], prepend=-1))
            for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
                i = order[a:b]
                words = self.words[group[i[0]]]
                if words.shape[1] > 1:
                    logs[i] += _log_share(p[i], words, self.groups.place[here[i]])
            out[lo : lo + block] = logs
        return out / np.log(10)


def _log_share(p: np.ndarray, q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The logarithm of entry k of the softmax of each row of p @ q, for as many rows at a time as caches hold."""
    out = np.empty(len(p))
    rows = max(1, 200_000 // q.shape[1])
    for lo in range(0, len(p), rows):
        s = p[lo : lo + rows] @ q
        own = s[np.arange(len(s)), k[lo : lo + rows]].astype(np.float64)
        top = s.max()
        if top > 60 or own.min() < -60:  # too far apart for exponentials of 32 bits without a shift
            most = s.max(axis=1)
            out[lo : lo + rows] = own - most - np.log(np.exp(s - most[:, None]).sum(axis=1))
        else:
            out[lo : lo + rows] = own - np.log(np.exp(s, out=s).sum(axis=1))
    return out


# ---------------------------------------------------------------- scoring


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most `most` tokens reach, to within a bin; bins are so few that any corpus fits."""
    n = F.col("n")
    # bins of 1 to 1024 hold one count each, later ones a 64th of a power of two
    at = F.when(n <= 1024, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n) * 64) / 64)).cast("double")
    bins = sorted(((r[0], r[1]) for r in counts.groupBy(at.alias("at")).agg(F.count("*")).collect()), reverse=True)
    least, seen = float("inf"), 0
    for value, k in bins:
        if seen + k > most:
            break
        least, seen = value, seen + k
    return int(np.ceil(least)) if seen else 2**62


def language_model(docs: DataFrame, m: Model = Model()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs.

    Tokens are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased, then one end of text; null is the empty text, which has only
    its end. The model learns from all rows with crc32(doc_id) mod 5 other than 1 (a null id counts as the empty text);
    train_tokens is their number of tokens. base_score is the base-10 log-likelihood by smoothed unigram counts, score
    that of the model. Without training rows all counts are 0 and the model is its starting point. Repeated
    rows count as often as they occur and each get a row; other columns are ignored.

    A frequent token's probability is the log-bilinear model's for the two tokens before, normalised in two steps: over
    groups of tokens, and within the token's group. Any other token's is its class's probability times its smoothed
    share of the class's count, in which one unseen token counts as well. Tokens are told apart by 64-bit hashes.
    Scores do not depend on how the rows are partitioned, nor on their order.
    """
    spark = docs.sparkSession
    bounded_batches(docs)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = held_in(F.col("doc_id"), 1)
    learn = docs.where(~held)
    counts = cut(token_counts(learn, m))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = int(END)
    head = counts.where((F.col("token") == end) | (F.col("n") >= _least_count(counts, m.common))).select("token", "n")
    head = head.orderBy((F.col("token") != end).cast("int"), F.desc("n"), "token").toArrow()
    token, n = (np.asarray(head.column(c)) for c in ("token", "n"))
    voc = Vocabulary(token.view(np.uint64), n, m)
    shared_voc = spark.sparkContext.broadcast(voc)

    # Counts of the classes: all tokens without a vector of their own.
    own = spark.createDataFrame([(int(t),) for t in token[: voc.words]] or [(end,)], "token long")
    rest = counts.join(F.broadcast(own), "token", "left_anti").groupBy("cls").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 0.5).alias("mass")).collect()
    mass, noise = np.full(m.classes, 0.5), np.full(voc.words + m.classes, 0.5)
    noise[: voc.words] += n[: voc.words]
    for r in rest:
        mass[r.cls] += r.mass
        noise[voc.words + r.cls] += r.n
    noise /= noise.sum()
    groups = Groups(noise)

    warm = Trainer(start(m, noise, groups), noise, groups, m)
    # a bounded sample in hash order: hashes alone decide which texts come to the driver
    drawn = learn.where(F.length("text") <= m.warm_chars * 10 // m.warm_docs).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    last = drawn.select("h").orderBy("h").limit(m.warm_docs).agg(F.max("h")).first()[0]
    sample = drawn.where(F.col("h") <= last).limit(m.warm_docs).collect() if last is not None else []
    texts = [r.text for r in sorted(sample)]
    for _, _, h, cls, ends in tokens(pa.array(texts, pa.string()), m.classes):
        for _ in range(2):
            warm.learn(voc.look_up(h, cls)[0], ends)
    learners = max(1, min(m.learners, -(-total // m.share)))
    theta = train(learn, shared_voc, noise, groups, warm.theta, learners, m)
    shared = spark.sparkContext.broadcast((Tables(theta, groups), np.log10(mass)))

    kind = pa.struct([("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.int64()))])

    @arrow_udf("struct<n:long,known:long,base:double,model:double,rare:array<long>>")
    def score(texts: pa.Array) -> pa.Array:
        tables, log_mass = shared.value
        out: list[list] = [[], [], [], []]
        rare = []
        for _, _, h, cls, ends in tokens(texts, m.classes):
            ids, c = shared_voc.value.look_up(h, cls)
            one, two = contexts(ids, ends)
            logs = tables.log10(one, two, ids)
            common = c >= 0
            smoothed = np.where(common, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            tail = ids >= shared_voc.value.words
            logs += np.where(tail, smoothed - log_mass[cls], 0.0)
            begin = np.concatenate([[0], ends[:-1]])
            for x, values in zip(out, (np.ones(len(h)), common, smoothed, logs), strict=True):
                x.append(np.add.reduceat(values.astype(np.float64), begin))
            lone = np.cumsum(~common)
            keys = h[~common].view(np.int64)
            rare.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lone[ends - 1]]).astype(np.int32)), pa.array(keys)))
        if not rare:
            return pa.array([], kind)
        n, known, base, model = (np.concatenate(x) for x in out)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(model), pa.concat_arrays(rare)], fields=list(kind))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held.alias("held_out"), score("text").alias("s"))
    rows = cut(rows.select("rid", "doc_id", "held_out", "s.*"))
    rare = rows.select("rid", F.explode("rare").alias("token"))
    found = rare.join(counts.select("token", F.col("n").alias("c")), "token", "left")
    sums = found.groupBy("rid").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    out = rows.drop("rare").join(sums, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    floor = F.lit(float(np.log10(total + 0.5 * (types + 1))))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs - F.col("n") * floor).alias("base_score"), (F.col("model") + logs).alias("score"))
