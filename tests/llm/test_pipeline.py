import random

import __spark_entry__ as entry
import corpus_pipeline


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    assert "pipeline" in entry.queries()
    for i in range(1, 11):
        assert sum(q.startswith(f"op{i}_") for q in entry.queries()) == 1


def test_pipeline_on_planted_documents(spark, tmp_path):
    rng = random.Random(13)
    vocabulary = [f"{a}{b}" for a in ("ba", "ki", "lo", "mu", "ne", "so") for b in ("dar", "fen", "gil", "hup", "rox", "tam", "vin")]
    text = lambda n=60: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, text() + (" moron idiot" * 4 if toxic else ""), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    item = text(30)
    clean = rows[1][1]
    rows += [(1000, clean + " ", "en", "s0", 0), (1001, clean + "\n\n", "en", "s1", 0), (1002, " ".join([*rows[2][1].split()[:-1], "other"]), "en", "s0", 0)]
    rows += [(1003, text() + " " + " ".join(item.split()[5:20]) + " " + text(), "en", "s1", 0), (1004, "you moron idiot " * 10, "en", "s1", 0), (1005, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen, step = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        step = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r.doc_id for r in step.select("doc_id").collect()}
    tox, exact, near, clean_set, mixed = seen.values()
    assert 1004 not in tox and len([i for i in tox if i < 400 and i % 5]) == 320 and len([i for i in tox if i < 400 and i % 5 == 0]) <= 4
    assert exact & {1, 1000, 1001} == {1001} and tox - exact == {1, 1000}
    assert exact - near == {1002}
    assert near - clean_set == {1003}
    assert mixed <= clean_set and len(mixed) > 250
    final = sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, d).collect())
    assert final == sorted((r.doc_id, r.taken) for r in step.collect())
