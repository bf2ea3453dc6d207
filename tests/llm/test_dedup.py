import random
import re

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common
from weftgraph.llm.exact_dedup import exact_dedup, exact_groups
from weftgraph.llm.line_dedup import Tree, drop_recurring_lines, recurring_lines
from weftgraph.llm.near_dups import Forest, jaccard_join, near_dedup, tries

AWKWARD = [(1, "a b"), (2, "ab "), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\f"), (7, "x" * 300_000), (None, "ab"), (8, "é ß 漢字"), (8, "é ß 漢字"), (9, "é ß")]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("kept", "keep_id", "rowkey", "n_links", "n_lines", "lines", "dropped", "norm")])


def words(t):
    t = (t or "").translate(str.maketrans(common.UPPER, common.LOWER))
    return re.findall(common.WORD_CLASS, t)


def test_exact_groups(spark):
    got = exact_groups(docs_of(spark, AWKWARD), partitions=5).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.chars): r for r in got}
    assert (by[1, 3].keep_id, by[1, 3].group_size, by[1, 3].kept) == (3, 4, False)
    assert by[3, 4].kept and not by[None, 2].kept
    assert (by[4, 0].keep_id, by[6, 3].keep_id, by[5, 0].group_size) == (6, 6, 3)
    assert sum(r.kept for r in got if r.doc_id == 8) == 1
    assert by[9, 3].keep_id == 9


def test_exact_groups_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, "hot text " + " " * rng.randrange(3)) for i in range(300)] + [(1000 + i, f"t{i % 50} {'z' * (i % 3)}") for i in range(300)]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), partitions=37).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(common.SPACE_CLASS, "", t), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted({k for k, _ in want.values()})


def test_exact_dedup_keeps_rows_and_columns(spark):
    docs = docs_of(spark, AWKWARD)
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect())) == [3, 6, 7, 8, 9]
    empty = docs.limit(0)
    assert exact_dedup(empty).count() == exact_groups(empty).count() == 0


def family(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.choice([3, 20, 80]))
        for _ in range(rng.choice([1, 2, 6])):
            t = list(text)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    return rows + [(len(rows), rows[0][1].upper()), (len(rows) + 1, None), (len(rows) + 2, "!?"), (len(rows) + 3, ""), (None, rows[5][1])]


def brute(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for x in range(len(rows)):
        i = rows[x][0]
        least[root(x)] = min(least.get(root(x), float("inf")), float("inf") if i is None else i)
    return sorted((i, least[root(x)] if least[root(x)] < float("inf") else None, n[x]) for x, (i, _) in enumerate(rows) if i is not None)


@pytest.mark.parametrize(("tile", "tile_bytes"), [(2, 1 << 24), (256, 1 << 24), (256, 1000)])
def test_jaccard_join_equals_brute_force(spark, tile, tile_bytes):
    rows = family(2)
    got = jaccard_join(docs_of(spark, rows), Forest(tile=tile, tile_bytes=tile_bytes, sketch_bits=16))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect() if r.doc_id is not None) == brute(rows)


def test_near_dedup_keeps_one_of_each_class(spark):
    rows = family(3)
    docs = docs_of(spark, rows)
    out = near_dedup(docs)
    assert out.columns == docs.columns
    want = sorted({c for _, c, _ in brute(rows) if c is not None})
    assert sorted(r.doc_id for r in out.collect()) == want
    assert near_dedup(docs.limit(0)).count() == 0


def test_the_floor_is_the_longest_prefix_that_reaches_the_recall():
    f = Forest()
    miss = lambda d: (1 - f.threshold**d) ** f.trees
    assert miss(f.floor) <= 1 - f.recall < miss(f.floor + 1)
    assert list(f.levels) == [8, 7, 6]


@pytest.mark.parametrize("partitions", [1, 7])
def test_tries_join_what_shares_a_prefix(spark, partitions):
    """At each depth, ties of that depth and deeper ones connect exactly the nodes that share a prefix in some trie."""
    rng = random.Random(17)
    f = Forest(trees=3)
    nodes = []
    for i in range(120):
        labels = [[rng.randrange(2) if k < 6 else rng.randrange(3) for k in range(8)] for _ in range(f.trees)]
        nodes.append((bytes([i, *[7] * 15]), labels))
    as_long = lambda x: int.from_bytes(bytes([200 + x[0], *x[1:]]), "big", signed=True)
    df = spark.createDataFrame([(bytearray(n), [as_long(x) for x in ls]) for n, ls in nodes], "fp binary, labels array<long>")
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(partitions))
        ties = tries(df.repartition(partitions), f).collect()
    finally:
        spark.conf.set(key, before)

    def groups(pairs):
        parent = {n: n for n, _ in nodes}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        out = {}
        for n, _ in nodes:
            out.setdefault(root(n), set()).add(n)
        return sorted(map(sorted, out.values()))

    for d in f.levels:
        want = [(a, b) for a, x in nodes for b, y in nodes if any(p[:d] == q[:d] for p, q in zip(x, y, strict=True))]
        assert groups((bytes(r.a), bytes(r.b)) for r in ties if r.d >= d) == groups(want)


def test_prefixes_are_shortened_until_the_recall_is_reached(spark, monkeypatch):
    from weftgraph.llm import near_dups

    seen = []
    joined = near_dups._joined
    monkeypatch.setattr(near_dups, "_joined", lambda *args: seen.append(1) or joined(*args))
    rng = random.Random(18)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(104)]
    copies, edge = [], []
    for i in range(20):
        base = text()
        copies += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "more"]))]
        edge += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:52], "x", *base[53:80], "y", *base[81:]]))]
    for rows, rounds in ((copies, 1), (edge, 2)):
        seen.clear()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs_of(spark, rows)).collect()) == brute(rows)
        assert len(seen) == rounds


def test_recurring_lines(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    own = ["red fox jumps far away today", "blue whales sing in cold water", "seven tall men walk home late", "no rain fell on the plain", "every door was shut at night", "two old clocks tick without rest", "green leaves turn brown each fall", "little birds eat seeds all winter"]
    rows = [(i, f"{own[i]}\nSeen by user {i * 37} on day {i}\n{passage if i < 2 else ''}") for i in range(8)]
    rows += [(20 + i, f"Posted by {n} in the long running weekly section about gardens") for i, n in enumerate(["Ann", "Bob", "Cid", "Dan"])]
    rows += [(30, "a line that only this text and its copies have\n"), (31, "a line that only this text and its copies have\n"), (40, None), (41, ""), (None, "\n \n")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in recurring_lines(docs, Tree(sketch_bits=16)).collect()}
    assert [list(got[i].dropped) for i in range(8)] == [[1, 2], [1, 2], *[[1]] * 6]
    assert [list(got[20 + i].dropped) for i in range(4)] == [[0]] * 4
    assert list(got[30].dropped) == list(got[31].dropped) == []
    assert (got[40].n_lines, got[41].n_lines, got[None].n_lines, got[None].n_dropped) == (0, 0, 3, 0)
    cleaned = {r.doc_id: r.text for r in drop_recurring_lines(docs, Tree(sketch_bits=16)).collect()}
    assert cleaned[3] == own[3] + "\n" and cleaned[40] is None
    assert recurring_lines(docs.limit(0)).count() == 0


def test_recurring_lines_of_few_tokens(spark):
    rows = [(i, f"All rights reserved.\nPosted by {n} here\n{own}") for i, (n, own) in enumerate([("Ann", "one fish swims"), ("Bob", "two cats"), ("Cid", "dog")])]
    got = {r.doc_id: list(r.dropped) for r in recurring_lines(docs_of(spark, rows), Tree(sketch_bits=16)).collect()}
    assert got == {i: [0, 1] for i in range(3)}


def test_recurring_lines_count_each_text_once(spark):
    recipe = "Add the red onion to the pan\nAdd the green pepper to the pan\nAdd the white garlic to the pan"
    numbers = ["1 2 3 4 5", "6 7 8 9 10", "11 12 13 14 15"]
    rows = [(0, recipe)] + [(1 + i, f"{x}\n2024 10 11 12 13") for i, x in enumerate(numbers)]
    got = {r.doc_id: list(r.dropped) for r in recurring_lines(docs_of(spark, rows), Tree(sketch_bits=16)).collect()}
    assert got == {0: [], 1: [1], 2: [1], 3: [1]}
    more = [(10, "Add the black pepper to the pan"), (11, "Add the fresh basil to the pan")]
    got = {r.doc_id: list(r.dropped) for r in recurring_lines(docs_of(spark, rows + more), Tree(sketch_bits=16)).collect()}
    assert got == {0: [0, 1, 2], 1: [1], 2: [1], 3: [1], 10: [0], 11: [0]}


def test_recurring_lines_that_differ_in_every_part(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(58)]
    names = [[*words[:42], f"x{n}"] for n in "abc"]
    for k, line in enumerate(names):
        for j in range(3, 42, 5):
            line[j] = f"own{'abc'[k]}{words[j]}"
    changed = [["pass", "age", *words] for _ in range(2)]
    changed[1][30] = "other"
    rows = [(i, " ".join(x) + f"\nPosted by {n}") for i, (x, n) in enumerate(zip(names, ["Ann", "Bob", "Cid"], strict=True))] + [(10 + i, " ".join(x)) for i, x in enumerate(changed)]
    got = {r.doc_id: list(r.dropped) for r in recurring_lines(docs_of(spark, rows), Tree(sketch_bits=16)).collect()}
    assert got == {0: [0, 1], 1: [0, 1], 2: [0, 1], 10: [0], 11: [0]}


def brute_lines(rows, t):
    """Dropped line numbers by a plain reading of the tree's rules."""
    texts = {x for _, x in rows if x}
    found = {}  # different lines with the texts that have them
    star = lambda w: "*" if re.search("[0-9]", w) else w
    for x in texts:
        for line in x.split("\n"):
            raw = tuple(re.findall(common.TOKEN_CLASS, line))
            if raw:
                found.setdefault(tuple(map(star, raw)), []).append((x, raw))
    bad, exact = set(), {}
    need = lambda n: 2 if n >= t.long else t.docs
    plain = lambda line: sum(w != "*" for w in line)
    leaves = {}
    for line, held in found.items():
        leaves.setdefault((len(line), line[: t.lead]), []).append(line)
        if len({x for x, _ in held}) >= need(len(line)) and plain(line) >= t.constant * len(line):
            bad.add(line)
        for x, raw in held:
            exact.setdefault(raw, set()).add(x)
    for (n, _), lines in leaves.items():
        at = {}
        for line in lines:
            for k, w in enumerate(line):
                at.setdefault((k, w), set()).update(x for x, _ in found[line])
        groups = {}
        for line in lines:
            template = tuple(w if w != "*" and len(at[k, w]) >= need(n) else None for k, w in enumerate(line))
            if sum(w is not None for w in template) >= t.constant * n:
                groups.setdefault(template, []).append(line)
        for same in groups.values():
            if len({x for line in same for x, _ in found[line]}) >= need(n):
                bad.update(same)
    out = {}
    for i, x in rows:
        out[i] = []
        for k, line in enumerate((x or "").split("\n")):
            raw = tuple(re.findall(common.TOKEN_CLASS, line))
            whole = tuple(map(star, raw))
            if raw and (whole in bad or plain(whole) < len(raw) and len(exact[raw]) >= need(len(raw))):
                out[i].append(k)
    return out


@pytest.mark.parametrize(("lines", "tokens"), [(4096, 1_000_000), (4096, 50), (3, 50), (1, 1)])
def test_recurring_lines_equal_brute_force(spark, lines, tokens):
    """Leaves that go whole to a task and leaves that are counted over all tasks give the same."""
    rng = random.Random(21)
    rows = []
    for i in range(160):
        text = []
        for _ in range(rng.randrange(5)):
            n = rng.choice([1, 2, 4, 6, 9, 55])
            text.append(" ".join(rng.choice(["red", "fox", rng.choice("abcdefgh"), rng.choice(["7", "x9", "ran"])]) for _ in range(n)))
        if i % 3 == 0:
            text.append(f"Posted by {rng.choice('UVWXYZ')}{'q' * (i % 4)} in the weekly section about {rng.choice(['gardens', 'rivers', 'birds'])}")
        rows.append((i, "\n".join(text)))
    rows += [(200, rows[0][1]), (201, None), (202, "")]
    t = Tree(sketch_bits=16, lines=lines, tokens=tokens)
    want = brute_lines(rows, t)
    assert {r.doc_id: list(r.dropped) for r in recurring_lines(docs_of(spark, rows), t).collect()} == want
    assert sum(map(len, want.values())) > 50


def test_ids_may_be_text(spark):
    rows = [("a", "one two three four five six"), ("b", "one two  three four five six"), ("c", "one two three four five six"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.keep_id for r in exact_groups(docs).collect()} == {"a": "b", "b": "b", "c": "b", None: None}
    assert sorted(r.doc_id or "" for r in exact_dedup(docs).collect()) == ["", "b"]
    assert {r.doc_id: r.class_id for r in jaccard_join(docs).collect()} == {"a": "a", "b": "a", "c": "a", None: None}
    assert {r.doc_id: r.n_lines for r in recurring_lines(docs).collect()} == {"a": 1, "b": 1, "c": 1, None: 1}
    assert drop_recurring_lines(docs).count() == 4


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}


def test_word_kernels_split_long_texts():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    texts = [None, "", "A b", " ".join(rng.choice(["äö", "x1", "Foo", "-", "y" * 50]) for _ in range(5000))]
    for limit in (100, 1 << 20):
        seen = []
        for lo, hi, h, ends in common.hashed_words(pa.array(texts), common.WORD_BYTES, limit):
            seen += [tuple(x.tolist()) for x in np.split(h, ends[:-1])]
        names = {}
        for t, got in zip(texts, seen, strict=True):
            assert len(got) == len(words(t))
            for w, k in zip(words(t), got, strict=True):
                assert names.setdefault(w, k) == k
        assert len(set(names.values())) == len(names)


def test_batches_are_bounded_unless_the_user_says_otherwise(spark):
    key, df = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(1)
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        common.bounded_batches(df)
        assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
        spark.conf.set(key, "1000000")
        common.bounded_batches(df)
        assert int(spark.conf.get(key).rstrip("b")) == 1_000_000
    finally:
        spark.conf.set(key, before)
