"""Very long texts, empty tables and repeated rows through every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm.decontaminate import decontaminate
from weftgraph.llm.html_text import extract_text
from weftgraph.llm.licences import licence_scan
from weftgraph.llm.line_dedup import recurring_lines
from weftgraph.llm.mixing import mix_sources
from weftgraph.llm.near_dups import jaccard_join
from weftgraph.llm.secrets import secret_spans

N = 300_000
WORDS = [f"w{i % 9973}x{i // 9973}" for i in range(N)]
LONG = " ".join(WORDS)
PASSAGE = "the quick brown fox jumps over the lazy dog again today"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"{LONG} {PASSAGE} all rights reserved password=hunter2hunter2"), (2, " ".join([*WORDS[:-1000], *("y" * 1000)])), (3, "short"), (3, "short"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([("a", PASSAGE), ("b", PASSAGE), (None, LONG)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, list(got[1]["items"])) == (N + 16, N + 11, ["a", "b"])
    assert got[2].n_hit == N - 1000 and not got[3].contaminated and got[None].n_words == 0


def test_lines(docs):
    got = [(r.doc_id, r.n_lines, r.n_dropped) for r in recurring_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 0), (2, 1, 0), (3, 1, 0), (3, 1, 0), (None, 0, 0)], key=str)


def test_jaccard(docs):
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in jaccard_join(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 3, 1, True), (3, 3, 1, True), (None, None, 0, True)], key=str)


def test_mix(docs):
    got = mix_sources(docs).collect()
    assert {r.doc_id: r["size"] for r in got} == {1: N + 15, 2: N, 3: 1, None: 0}
    assert abs(sum(r.taken for r in got) - round(1.5 * (2 * N + 17))) <= 1


def test_secrets_and_licences(docs):
    start = len(LONG) + 1 + len(PASSAGE) + 1 + len("all rights reserved") + 1
    got = {r.doc_id: r for r in secret_spans(docs).collect()}
    assert (got[1].n_assign, got[1].base_spans) == (1, f"assign:{start}:{start + 23}") and got[3].spans == got[None].spans == ""
    got = licence_scan(docs).collect()
    assert [(r.n_words, r.n_base, r.first_word) for r in got if r.doc_id == 1] == [(N + 16, 1, N + 11)]
    assert sum(r.doc_id == 3 for r in got) == 2
    assert licence_scan(docs.limit(0)).count() == 0


def test_pages(spark):
    page = f"<nav>menu</nav><article><h1>Head</h1>{''.join(f'<p>{w} some words of a paragraph' for w in WORDS[:50_000])}</article><footer>end</footer>"
    one = extract_text(spark.createDataFrame([(1, page), (1, page)], "page_id long, html string")).collect()
    assert [r.text == one[0].text and r.n_chars for r in one] == [len(one[0].text)] * 2
    assert one[0].text.startswith("Head w0x0 some") and one[0].text.endswith(f"{WORDS[49_999]} some words of a paragraph")


def test_pipeline_of_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 13), (1, "one two three", "en", "s", 13), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.limit(0).write.parquet(f"{d}/a/documents.parquet")
    docs.write.parquet(f"{d}/b/documents.parquet")
    for x in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/{x}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/{x}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{d}/a").count() == 0
    got = corpus_pipeline.run(spark, f"{d}/b").collect()
    assert [(r.doc_id, r["size"]) for r in got] == [(1, 3)]
