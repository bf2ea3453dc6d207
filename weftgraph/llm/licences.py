"""License scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from weftgraph.llm.common import WORD_BYTES, bounded_batches, pieces, without

#: Phrases of the base scan, as words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices, as words, with label.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "do not distribute": "reserved",
}
TAG = "spdx license identifier"
#: How far a licence lets others reuse the text, by the first matching beginning of its identifier.
REUSE = (("cc0", 1.0), ("public-domain", 1.0), ("unlicense", 1.0), ("cc-by-nc", 0.2), ("cc-by-nd", 0.2), ("cc-by-sa", 0.6), ("cc-by", 0.9), ("mit", 1.0), ("apache", 1.0), ("bsd", 1.0), ("isc", 1.0), ("bsl", 1.0), ("zlib", 1.0), ("mpl", 0.7), ("epl", 0.7), ("lgpl", 0.6), ("agpl", 0.3), ("gpl", 0.4), ("reserved", 0.0))
#: Evidence of a tag, a base phrase and another notice that a text is under a licence.
WEIGHT = {"tag": 0.95, "base": 0.8, "notice": 0.7}

_LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_ORDER = {"or": 1, "and": 2, "with": 3}


def reuse(label: str) -> float:
    return next((v for k, v in REUSE if label.startswith(k)), 0.5)


def parse(text: str) -> list[str]:
    """The licence expression at the beginning of text, in postfix order; what cannot go on an expression ends it.

    Unmatched parentheses are ignored. Operators bind with, and, or, from tight to loose.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = True  # what may come next
    at = 0
    while m := _PIECE.match(text, at):
        x = m[1]
        if x == "(" and operand:
            ops.append(x)
        elif x == ")" and not operand and "(" in ops:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif x in _ORDER and not operand:
            while ops and ops[-1] != "(" and _ORDER[ops[-1]] >= _ORDER[x]:
                out.append(ops.pop())
            ops.append(x)
            operand = True
        elif operand and x not in _ORDER and x not in "()":
            out.append(x.rstrip(".:-"))
            operand = False
        else:
            break
        at = m.end()
    while ops:
        out.append(ops.pop())
    return [x for x in out if x != "("]


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """Licences that an expression names and how far it allows reuse: or takes the better side, and the worse;
    a with-exception lifts its licence halfway to 1. An operator without its operands is left out."""
    stack: list[tuple[set[str], float]] = []
    for x in postfix:
        if x not in _ORDER:
            stack.append(({x}, reuse(x)))
        elif len(stack) > 1:
            (b, v), (a, u) = stack.pop(), stack.pop()
            if x == "with":
                stack.append((a, (u + 1) / 2))
            else:
                stack.append((a | b, max(u, v) if x == "or" else min(u, v)))
    if not stack:
        return None
    return set().union(*(s for s, _ in stack)), min(v for _, v in stack)


@lru_cache(1)
def automaton():
    import ahocorasick

    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, marks in found.items():
        a.add_word(phrase, (len(phrase), marks))
    a.make_automaton()
    return a


def matches(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, str, str, int]]]:
    """Word counts of a run of texts, and (text, word, kind, label, byte after the phrase) of each phrase found."""
    b = np.frombuffer(raw.translate(WORD_BYTES), np.uint8).copy()
    b[at[1:] - 1] = 10  # ends of texts
    blank = b <= 32
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    first = np.searchsorted(starts, at)
    keep = np.flatnonzero((b != 32) | ~np.concatenate([[True], blank[:-1]]))
    line = b[keep].tobytes().decode("latin-1")
    out = []
    for end, (n, marks) in automaton().iter(line):
        lo = end - n + 1
        if (lo == 0 or line[lo - 1] <= " ") and line[end + 1] <= " ":
            start, stop = int(keep[lo]), int(keep[end]) + 1
            text = int(np.searchsorted(at, start, "right")) - 1
            word = int(np.searchsorted(starts, start) - first[text])
            out += [(text, word, kind, label, stop) for kind, label in marks]
    return np.diff(first), out


_KIND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("reuse", pa.float64())])
_SQL_KIND = StructType([StructField(f.name, {pa.int64(): LongType(), pa.string(): StringType(), pa.float64(): DoubleType()}[f.type]) for f in _KIND])


@arrow_udf(_SQL_KIND)
def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for lo, hi, raw, at in pieces(texts, _LOWER_BYTES):
        counts, found = matches(raw, at)
        mine: dict[int, list] = {}
        for x in found:
            mine.setdefault(x[0], []).append(x)
        for i, n in enumerate(counts.tolist()):
            if i not in mine:
                rows.append((n, 0, None, None, "", "", 0.0, None))
                continue
            base, labels, doubt, allowed = set(), set(), 1.0, []
            places = [w for _, w, kind, _, _ in mine[i] if kind == "base"]
            for _, _, kind, label, stop in mine[i]:
                if kind == "tag":
                    line = raw[stop : at[i + 1] - 1].split(b"\n", 1)[0].decode("utf-8", "replace").lstrip(" \t:=")
                    got = evaluate(parse(line))
                    if got:
                        labels |= got[0]
                        allowed.append(got[1])
                        doubt = min(doubt, 1 - WEIGHT["tag"])
                    continue
                (base if kind == "base" else labels).add(label)
            for label in base:
                doubt *= 1 - WEIGHT["base"]
            for _ in labels - base:
                doubt *= 1 - WEIGHT["notice"]
            labels |= base
            allowed += [reuse(x) for x in labels] if not allowed else []
            rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - doubt, min(allowed, default=None)))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_KIND)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))


def licence_scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and reuse added.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. Base: places where a phrase's words
    stand in a row, overlapping ones included; n_base counts them, first_word and last_word are their smallest and
    largest first word (null without any). labels adds those of further notices and of the expressions after
    SPDX tags, both distinct, sorted and comma-joined. score is the evidence that the text is under some
    licence (0: none found); reuse, 0 to 1, how far the strictest expression, or without one the strictest label,
    lets others use it (null without any). Null and empty texts have no words. Repeated rows and all other columns
    stay; columns with the added names are replaced.
    """
    names = [f.name for f in _KIND]
    bounded_batches(docs)
    docs = without(docs, *names, "_marks")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("_marks", _scan(F.col("text"))).select(*kept, *[F.col(f"_marks.{n}") for n in names])
