"""Toxicity scores from a bag of subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from weftgraph.llm.common import WORD_BYTES, bounded_batches, held_in, mix, pieces, without


@dataclass(frozen=True)
class Settings:
    """max_docs and max_chars bound the sample of labelled texts that the model is fitted on.

    A subword of share q of the sample counts common / (common + q) in a text's mean, so that those of every other text do
    not drown the others; subwords of fewer than `least` texts, or one in `rare`, have no vector. A mean takes in `blanks`
    subwords of no weight, so that a few subwords alone decide nothing; `gain` scales it before the softmax.
    """

    max_docs: int = 12_000
    max_chars: int = 60_000_000
    bits: int = 20
    dim: int = 8
    shortest: int = 3
    longest: int = 6
    common: float = 1e-4
    least: int = 5
    rare: int = 200
    updates: int = 40_000
    rate: float = 0.5
    decay: float = 1e-3
    gain: float = 300.0
    blanks: float = 100.0
    seed: int = 7


_ODD = np.uint64(0x9E3779B97F4A7C17)


def subwords(data: bytes, s: Settings):
    """For each length: a mask of the byte positions at which a character n-gram starts, and its bucket.

    Words come blank-separated; an n-gram may begin or end with the blank around its word, but not span it.
    """
    b = np.frombuffer(data, np.uint8)
    blank = b == 32
    x = b.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(b), np.uint64)
    inner = np.zeros(len(b), bool)  # a blank after the first byte and before the last
    for n in range(1, s.longest + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        h = h[:m] * _ODD + x[n - 1 :]
        if n > 2:
            inner = inner[:m] | blank[n - 2 : n - 2 + m]
        if n >= s.shortest:
            ok = np.flatnonzero(~inner[:m])
            yield ok, (mix(h[ok] + np.uint64(n)) >> np.uint64(64 - s.bits)).astype(np.int64)


def _plain(text: str) -> bytes:
    """Lower-case words with a blank around each."""
    return b" " + b" ".join(w for _, _, data, _ in pieces(pa.array([text]), WORD_BYTES) for w in data.split()) + b" "


class Sample:
    """Texts of the sample as bags of subwords; only one text's subwords are held at a time before the rare ones are gone."""

    def __init__(self, texts: Iterable[str], s: Settings):
        size = 1 << s.bits
        words, seen = [], np.zeros(size, bool)
        self.docs, self.total = np.zeros(size, np.int32), np.zeros(size)
        for t in texts:
            words.append(_plain(t))
            for _, ids in subwords(words[-1], s):
                seen[ids] = True
                np.add.at(self.total, ids, 1)
            own = np.flatnonzero(seen)
            self.docs[own] += 1
            seen[own] = False
        self.kept = np.flatnonzero(self.docs >= max(s.least, len(words) // s.rare))
        slot = np.full(size, -1, np.int32)
        slot[self.kept] = np.arange(len(self.kept))
        self.bags: list[tuple[np.ndarray, np.ndarray, int]] = []
        for i in range(0, len(words), 256):
            # views of large arrays: many small ones would leave the driver's memory in pieces
            part = [self._bag(w, slot, s) for w in words[i : i + 256]]
            ends = np.cumsum([len(ids) for ids, _, _ in part])[:-1]
            ids, counts = (np.split(np.concatenate([x[k] for x in part]), ends) for k in (0, 1))
            self.bags += zip(ids, counts, (n for *_, n in part), strict=True)
            words[i : i + 256] = [b""] * len(part)

    @staticmethod
    def _bag(words: bytes, slot: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, int]:
        ids = np.concatenate([np.empty(0, np.int64), *(f for _, f in subwords(words, s))])
        kept, counts = np.unique(slot[ids], return_counts=True)
        first = 1 if len(kept) and kept[0] < 0 else 0
        return kept[first:], np.minimum(counts[first:], 65535).astype(np.uint16), len(ids)


def train(texts: Iterable[str], labels: list[int], s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax together; returns what each subword adds to the log-odds, and the bias.

    The weighted mean embedding of a text's subwords goes through a two-class softmax. Both layers take gradient steps of the
    cross-entropy, one text at a time, at a falling rate and with weight decay; steps are not scaled by how rare a
    subword is, as that would learn the texts by heart. As the classifier is linear, the two layers fold into one
    number per subword afterwards.
    """
    rng = np.random.default_rng(s.seed)
    sample = Sample(texts, s)
    weight = s.gain * s.common / (s.common + sample.total[sample.kept] / max(sample.total.sum(), 1.0))
    emb = rng.uniform(-0.1 / s.dim, 0.1 / s.dim, (len(sample.kept), s.dim)).astype(np.float32)
    out = rng.normal(0, 1, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sum_out, sum_bias = np.full(out.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    passes = max(3, min(10, s.updates // len(sample.bags)))
    odds, shift = np.zeros(1 << s.bits), 0.0
    for k in range(passes):
        rate = s.rate * (1 - k / passes)
        for i in rng.permutation(len(sample.bags)):
            ids, counts, n = sample.bags[i]
            share = (weight[ids] * counts / (n + s.blanks)).astype(np.float32)
            vectors = emb[ids]
            h = share @ vectors
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            step = np.outer(h, p)
            sum_out += step**2
            out -= rate * step / np.sqrt(sum_out)
            sum_bias += p**2
            bias -= rate * p / np.sqrt(sum_bias)
            emb[ids] = vectors * (1 - s.decay) - (rate * share)[:, None] * back
        if 2 * k >= passes - 1:  # the later passes are averaged
            odds[sample.kept] += weight * (emb @ (out[:, 1] - out[:, 0]))
            shift += float(bias[1] - bias[0])
    n = passes - (passes // 2)
    return (odds / n).astype(np.float32), shift / n


def labelled(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold: text, toxic; in hash order, so reruns agree."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_in(F.col("doc_id"), 0))
    known = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    chosen = known.where(~held_in(F.col("doc_id"), 0)).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(s.max_docs)
    return rows.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= s.max_chars * 10 // s.max_docs).orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(s.max_docs).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float] | None:
    """None where no labelled row is left."""
    toxic: list[int] = []

    def texts() -> Iterator[str]:
        chars = 0
        for r in labelled(docs, labels, s).toLocalIterator():
            chars += len(r.text)
            if chars > s.max_chars:
                return
            toxic.append(r.toxic)
            yield r.text

    found = texts()
    first = next(found, None)
    return None if first is None else train(chain([first], found), toxic, s)


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with held_out, score and predicted added.

    Each whole text is scored: the mean of its subwords' log-odds through the logistic function. Fitted on a sample
    of at most s.max_docs labelled rows (and s.max_chars characters; texts ten times over the mean that allows are not
    used for fitting) with crc32(doc_id) mod 5 other than 0. Null and empty texts have no subwords and score by the
    bias alone. Without labelled rows every score is 0. Null ids count as the empty text for the fold; null labels and
    those of documents with labels that contradict each other are ignored, equal ones count once; repeated rows score
    alike. doc_id may be of any type that labels' doc_id can be cast to. Columns with the added names are replaced.
    """
    bounded_batches(docs)
    docs = without(docs, "held_out", "score", "predicted", "_score")
    model = fit(docs, labels, s)
    if model is None:
        scored = docs.withColumn("_score", F.lit(0.0))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            odds, bias = shared.value
            parts = []
            for lo, hi, data, at in pieces(texts, WORD_BYTES):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                data, at = b" " + data, at + 1
                # long runs are taken in blocks that overlap by one n-gram; the second byte tells an n-gram's text
                step = 1 << 18
                for here in range(0, len(data), step):
                    for ok, ids in subwords(data[here : here + step + s.longest - 1], s):
                        mine = ok < step
                        text = np.searchsorted(at, ok[mine] + (here + 1), "right") - 1
                        total += np.bincount(text, odds[ids[mine]], hi - lo)
                        n += np.bincount(text, minlength=hi - lo)
                parts.append(1 / (1 + np.exp(-np.clip(total / (n + s.blanks) + bias, -30, 30))))
            return pa.array(np.concatenate(parts) if parts else np.empty(0))

        scored = docs.withColumn("_score", score(F.col("text")))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], held_in(F.col("doc_id"), 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
