import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import common
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm import html_text
from weftgraph.llm.html_text import extract_text, is_noise, main_text, surges
from weftgraph.llm.language_model import Groups, Model, Tables, language_model, start
from weftgraph.llm.licences import evaluate, licence_scan, parse
from weftgraph.llm.mixing import mix_sources, targets
from weftgraph.llm.secrets import ASSIGN, battery, secret_spans
from weftgraph.llm.toxicity import Settings, labelled, toxicity


def fold(t):
    return (t or "").translate(str.maketrans(common.UPPER, common.LOWER))


def words(t):
    return re.findall(common.WORD_CLASS, fold(t))


def frame(spark, rows, *clash):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("old").alias(c) for c in clash])


# ---------------------------------------------------------------- decontamination


def benchmark(rng, vocabulary):
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([10, 11, 14, 25, 40, 3, 1, 9])]
    return items + [(50, items[2][1].upper()), (51, None), (52, "?!"), (None, items[4][1])]


def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for p in range(len(w) - n + 1) if n else ():
            if tuple(w[p : p + n]) in grams:
                hit |= set(range(p, p + n))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [50_000_000, 60])
def test_decontaminate_equals_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "é", "x9"]
    items = benchmark(rng, vocabulary)
    texts = [None, "", "a", "!!"]
    for _ in range(40):
        t = rng.choices(vocabulary + ["zz"], k=rng.randrange(60))
        source = words(rng.choice(items)[1])
        k = rng.randrange(len(source) + 1)
        texts.append(" , ".join(t[:20] + source[k : k + rng.randrange(5, 20)] + t[20:]))
    docs = frame(spark, list(enumerate(texts)), "n_words", "items")
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_chars=block)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got.collect()} == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontaminate_without_items_or_docs(spark):
    docs, none = frame(spark, [(1, "a b c")]), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).first().contaminated is False
    assert decontaminate(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- mixing


def water_level(sizes, weights, budget):
    full, rest = {}, dict(sizes)
    while True:
        share = (budget - sum(full.values())) / sum(weights[s] for s in rest) if rest else 0
        over = [s for s in rest if share * weights[s] > 2 * rest[s] + 1e-9]
        if not over:
            return full | {s: share * weights[s] for s in rest}
        for s in over:
            full[s] = 2 * rest.pop(s)


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["b", "a", "a", "a", "É", None])) for i in range(400)]
    rows += [(900, None, "empty"), (901, "", "empty"), (7, "same text here", "b"), (7, "same text here", "b"), (None, "no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit(-1)).repartition(5)
    got = mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs.repartition(3)).collect()), key=str)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(re.findall(common.TOKEN_CLASS, r.text or "")) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted((s for s in target if s is not None)) + [None]
    want = water_level({s: size[s] for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()))
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 2
    assert mix_sources(docs.limit(0)).count() == 0


def test_targets_of_few_and_many_sources_agree(spark):
    rng = random.Random(6)
    sizes = spark.createDataFrame([(f"s{i}", rng.randrange(1, 10_000)) for i in range(60)] + [(None, 500), ("", 0)], "source string, source_size long")
    one, many = ({r.source: (r.weight, r.target) for r in targets(sizes, (3, 1, 2), 1.5, 2, k).collect()} for k in (1000, 10))
    assert len(one) == 62 and one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k]) for k in one)


# ---------------------------------------------------------------- toxicity


def test_toxicity_generalises_to_misspellings(spark):
    rng = random.Random(9)
    plain, bad = ["house", "garden", "river", "meadow", "window"], ["moronic", "moron", "idiotic", "idiots"]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        rows.append((i, " ".join(rng.choices(plain, k=60) + (rng.choices(bad, k=6) if toxic else []))))
        labels.append((i, int(toxic)))
    rows += [(5000, "you mor0n and idiott " * 5 + "house " * 30), (5001, "house garden " * 30), (5002, None), (5003, ""), (None, "river")]
    docs, known = frame(spark, rows, "score"), spark.createDataFrame([*labels, (5004, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity(docs, known)
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = {r.doc_id: r for r in got.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [(i, r) for i, r in got.items() if i is not None and i < 700 and r.held_out]
    assert sum((r.predicted == 1) == (i % 4 == 0) for i, r in held) / len(held) > 0.97
    assert got[5000].score > 0.5 > got[5001].score and 0 <= got[5002].score == got[5003].score <= 1
    twice = known.union(spark.createDataFrame([(i, 1 - int(i % 4 == 0)) for i in range(0, 20)] + labels[:50], "doc_id long, toxic int"))
    without = known.where("doc_id >= 20 or doc_id is null")
    assert sorted(map(tuple, labelled(docs, twice, Settings()).collect())) == sorted(map(tuple, labelled(docs, without, Settings()).collect()))
    alone = toxicity(docs, known.limit(0)).select(F.max("score")).first()[0]
    assert alone == 0 and toxicity(docs.limit(0), known, Settings()).count() == 0


def test_long_texts_score_as_a_whole(spark):
    rows = [(i, ("moron " if i % 2 else "house ") * 50) for i in range(200)]
    known = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    texts = [(1000, "house " * 600_000 + "moron " * 600_000), (1001, "moron " * 600_000 + "house " * 600_000)]
    got = {r.doc_id: r.score for r in toxicity(frame(spark, rows + texts), known).where("doc_id >= 1000").collect()}
    assert got[1000] == pytest.approx(got[1001], abs=1e-3)


# ---------------------------------------------------------------- language model


def test_language_model_counts_and_scores(spark):
    rng = random.Random(10)
    one, two = ["der", "die", "das", "und", "Haus"], ["the", "and", "of", "house", "tree"]
    rows = [(i, " ".join(rng.choices(one if i % 2 else two, k=40)) + (f" rare{i}" if i % 3 else "")) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "unseen " * 3), (None, "the tree"), (1, rows[1][1])]
    m = Model(words=8, least=2, classes=4, common=9, warm_docs=50, share=5_000)
    got = language_model(frame(spark, rows, "n", "score", "held_out", "rid"), m).collect()
    tokens = {i: re.findall(common.TOKEN_CLASS, fold(t)) + [None] for i, t in rows}
    count = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            count.update(re.findall(common.TOKEN_CLASS, fold(t)) + [None])
    n, v = sum(count.values()), len(count)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model(frame(spark, rows).limit(0), m).count() == 0


def test_token_probabilities_sum_to_one():
    m = Model(dim=6)
    share = np.random.default_rng(1).exponential(1, 24) ** 3
    groups = Groups(share / share.sum())
    assert sorted(np.concatenate(groups.members).tolist()) == list(range(24)) and 1 < len(groups.members) < 24
    t = Tables(start(m, share / share.sum(), groups), groups)
    k = np.arange(24)
    for a, b in ((0, 0), (3, 17), (23, 5)):
        total = (10 ** t.log10(np.full(24, a), np.full(24, b), k, block=7)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_language_model_does_not_depend_on_partitions(spark):
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", f"w{i % 7}"], k=rng.randrange(30)))) for i in range(200)]
    rows += [(900, "a b c " * 150_000)]
    m = Model(least=5, classes=4, warm_docs=20, share=100_000)
    docs = frame(spark, rows)
    one, two = ({r.doc_id: r.score for r in language_model(docs.repartition(k, *by), m).collect()} for k, by in ((1, ()), (7, ("doc_id",))))
    assert one == pytest.approx(two, rel=1e-6)
    assert one[900] > -450_001 * 0.5


# ---------------------------------------------------------------- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Short.</p>", "Short."),
        ("<title>T</title><script>var t='</p>';</script><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One <b>t</b>wo<br>three<p>4 &amp; 5 &lt;b&gt;</article><footer>f</footer>", "Head One two three 4 & 5 <b>"),
        ("<article><p>a</p><div class='ad'>buy</div><p>b</p></article><article class='comment'>no</article>", "a b"),
        ("<div id=header>Site</div><ul class=menu><li><a href=a>A</a></ul><div>" + "Some longer text of a page. " * 6 + "</div><form>q<input></form><div class='cookie-notice'>ok</div><p>tail</p>", " ".join(["Some longer text of a page."] * 6) + " tail"),
        ("<article>x<!-- c <p>no</p>", "x"),
        ("<article><p>x <script>never closed", "x"),
        ("a < b > c", "a < b > c"),
        ("<article>\n  much \t white\n\n space </article>", "much white space"),
        ("<article><h1>H</h1><p title='A hidden gem'>one</p><p hidden>x</p><p aria-hidden=true>y</p><p style='color:red; display: none'>z</p></article>", "H one"),
        ("<article><p id='related-work'>a</p><p class='share-price'>b</p><p class='share-buttons'>c</p><div class='adBanner'>d</div></article>", "a b"),
        ("<main><h1>Head</h1><p>intro</p><article>" + "<p>Some text of the article.</p>" * 9 + "</article></main><div>" + "Notes of the site. " * 5 + "</div>", "Head intro " + " ".join(["Some text of the article."] * 9)),
        ("<h2>Head</h2><div class=share>s</div><div class=ad>a</div><p>" + "Words of a paragraph. " * 8 + "</p><p>The end.</p><div></div><div></div><p>Tail</p>", "Head " + " ".join(["Words of a paragraph."] * 8) + " The end."),
        ("<div>" * 3000 + "<p>deep</p>", "deep"),
        ("<p class=\"never closed>text <b>more</b>", "text more"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_noise_needs_every_word_to_say_so():
    assert all(map(is_noise, ["ad", "AdBanner", "cookie-notice", "share_buttons", "comments-list-2", "sidebarRight"]))
    assert not any(map(is_noise, ["related-work", "share-price", "advice", "header-text", "socialism", "", "x1"]))


def test_surges_equal_brute_force():
    rng = random.Random(14)
    for _ in range(300):
        sizes = [rng.choice([0, 0, 0, 3, 10, 60]) for _ in range(rng.randrange(25))]
        width, least, n = rng.choice([1, 2, 3]), rng.choice([1, 20, 70]), len(sizes)
        want, i = [False] * n, 0
        while i < n:
            if not sizes[i] or sum(sizes[i : i + width]) < least:
                i += 1
                continue
            dive = next((j for j in range(i, n) if not sum(sizes[j : j + width])), n)
            last = max([i, *(j for j in range(i, dive) if sizes[j] and sum(sizes[max(0, j + 1 - width) : j + 1]) >= least)])
            for j in range(i, last + 1):
                want[j] = True
            i = max(dive, last + 1)
        for step in (1, -1):
            for j in range(n)[::step]:
                if want[j] and 0 <= j + step < n and sizes[j + step]:
                    want[j + step] = True
        assert surges(np.array(sizes, np.int64), width, least).tolist() == want


def test_the_distribution_finds_the_article_without_marks(monkeypatch):
    rng = random.Random(15)
    text = lambda n: " ".join(rng.choice(["river", "stone", "of", "the", "lamp"]) for _ in range(n))
    marked, plain = [], []
    for _ in range(60):
        paragraphs = "".join(f"<p>{text(rng.choice([2, 9, 30, 80]))}" for _ in range(rng.randrange(4, 9)))
        page = f"<nav><a href=x>{text(2)}</a></nav><div class='ad'>{text(9)}</div><article><h1>{text(5)}</h1>{paragraphs}</article><div class='notice'>{text(6)}</div><footer>{text(30)}</footer>"
        marked.append(page)
        plain.append(re.sub(" class='[a-z]*'", "", page).replace("article", "div"))
    want = [main_text(p) for p in marked]
    got = [main_text(p) for p in plain]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 55
    monkeypatch.setattr(html_text, "surges", lambda sizes, *_: np.ones(len(sizes), bool))
    assert not any(main_text(p) == w for p, w in zip(plain, want, strict=True))


def test_extract_text_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é一</article>"), (1, "u", "<article>é一</article>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_text(pages).collect())
    assert got == [(1, "é一", 2), (1, "é一", 2), (2, "", 0)]
    assert extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- secrets and licences


def test_secret_spans(spark):
    rng = random.Random(12)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    up, b64 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [None, "", "é PASSWORD = 'hunter2hunter2' ", "token: short secret: token: abcdefgh12", "AKIA" + key(16, up) + " AKIAX", "sha " + key(40, "0123456789abcdef") + " end", "api_key=" + key(20, b64)]
    texts += [f"see {key(64, b64)} here" for _ in range(60)] + [f"about chapter-{i}-of-the-long-story-version-{i} only" for i in range(60)]
    rows = list(enumerate(texts)) + [(2, texts[2])]
    got = secret_spans(frame(spark, rows, "spans", "found")).collect()
    assert len(got) == len(rows)
    kinds = [("assign", re.compile(ASSIGN, re.A), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    for r in got:
        t = texts[r.doc_id] or ""
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
        assert r.base_spans == ",".join(s for *_, s in spans)
        assert r.base_sha256 == hashlib.sha256(r.base_spans.encode()).hexdigest()
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
    added = {r.doc_id for r in got if "random" in r.spans}
    assert len(added & set(range(7, 67))) > 45 and not added & set(range(67, 127))
    assert secret_spans(frame(spark, rows).limit(0)).count() == 0


def test_random_strings_are_told_from_ordinary_ones(spark):
    """Keys outside the base patterns are found, at most a few ordinary strings with them; base spans are tested too."""
    rng = random.Random(30)
    b64, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz"
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    syllables = ["ing", "ter", "ation", "ver", "lich", "the", "con", "al", "re", "en", "st", "un"]
    long_word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(4, 9)))
    plain = [f"{long_word()} {long_word()} {long_word().title()}{rng.randrange(99)} {long_word()}-{long_word()}-{rng.randrange(9)}" for _ in range(400)]
    keys = [key(rng.choice([40, 64, 88]), b64[:62]) for _ in range(30)] + [key(64, b64) + "==" for _ in range(15)] + ["ey" + key(30, b64[:62]) + "." + key(60, b64[:62]) + "." + key(43, b64[:62]) for _ in range(5)]
    texts = plain + [f"{long_word()} {k} {long_word()}" for k in keys] + ["sha " + key(64, "0123456789abcdef"), "password: correcthorsebatterystaple", "secret=" + "." * 9, key(14, low)]
    got = {r.doc_id: r for r in secret_spans(frame(spark, list(enumerate(texts)))).collect()}
    false = [i for i in range(400) if "random" in got[i].spans]
    found = [i for i in range(400, 450) if "random" in got[i].spans]
    assert len(found) >= 45 and len(false) <= 3
    kind, start, end, encoding, p, even = got[450].tests.split(":")
    assert (kind, start, end, encoding) == ("hex", "4", "68", "hex") and float(p) > 0.001 and float(even) < 0.2
    assert got[451].tests.split(":")[3] == "lower" and got[452].tests.endswith(":-:-:-")
    assert all(r.spans == ",".join(":".join(x.split(":")[:3]) for x in r.tests.split(",")) for r in got.values())


def test_battery_p_values(spark):
    """p is uniform on random strings and follows numpy's statistics; ordinary strings have small ones."""
    rng = np.random.default_rng(31)
    low = "abcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(low[i] for i in rng.integers(0, 36, n)) for n in rng.choice([40, 64, 65, 200], 600)]
    tokens += ["1itwasthebestoftimesitwastheworstoftimesitwastheageofwisdomitwastheageoffoolishness", "a1" * 30, "z9" * 2000]
    got = [r.p for r in battery(spark.createDataFrame(list(enumerate(tokens)), "i int, token string")).orderBy("i").collect()]

    def normal_tail(z):
        return 0.5 * math.erfc(z / math.sqrt(2))

    for t, p in zip(tokens, got, strict=True):
        x = np.array([low[26:].index(c) if c.isdigit() else low.index(c) + 10 for c in t], float)
        n, k = len(x), 36
        chi = k / n * (np.bincount(x.astype(int)) ** 2).sum() - n
        z = [((chi / 35) ** (1 / 3) - (1 - 2 / 315)) / math.sqrt(2 / 315)]
        high = x >= k / 2
        h = high.sum()
        expected = 2 * h * (n - h) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z.append((1 + (high[1:] != high[:-1]).sum() - expected) / math.sqrt(spread) if spread > 0 else 8)
        d = x - x.mean()
        z.append((d[1:] @ d[:-1] / (d @ d) + 1 / n) * math.sqrt(n))
        ps = [normal_tail(z[0]), 2 * normal_tail(abs(z[1])), 2 * normal_tail(abs(z[2]))]
        s = -sum(math.log(max(v, 1e-12)) for v in ps)
        assert p == pytest.approx(min(1, math.exp(-s) * (1 + s + s * s / 2)), rel=1e-3, abs=1e-9)
    random_ones = np.sort(got[:600])
    assert np.abs(random_ones - np.arange(600) / 600).max() < 0.1  # runs are whole numbers, so p is uniform only about
    assert max(got[600:]) < 1e-3


def test_licence_scan(spark):
    texts = [None, "", "CC-BY CC BY cc by", "GNU General Public License, all rights reserved. submit license", "// SPDX-License-Identifier: MIT OR (GPL-2.0 WITH Classpath-exception-2.0)\nnext", "general public", "occ by", "General\nPublic  License"]
    got = {r.doc_id: r for r in licence_scan(frame(spark, list(enumerate(texts)), "labels")).collect()}
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in enumerate(texts):
        w = words(t)
        places = [(k, label) for p, label in base.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first = [k for k, _ in places]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(places), min(first, default=None), max(first, default=None))
        assert got[i].base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert got[4].labels == "gpl-2.0,mit" and got[4].reuse == 1.0 and got[3].reuse == 0.0


def test_expressions():
    assert parse("mit and apache-2.0 or cc0-1.0 rest") == ["mit", "apache-2.0", "and", "cc0-1.0", "or"]
    assert parse("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert evaluate(parse("gpl-3.0 with x or isc"))[0] == {"gpl-3.0", "isc"}
    assert evaluate(parse(") and")) is None
