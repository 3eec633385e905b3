import random
import re

import corpus_pipeline
from tideline.session import shared_folder


def test_stages_take_effect(spark, frame):
    """Planted cases of every stage; clean documents go through whole."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, passage = prose(40), prose(60)
    rows = [(i, prose(80) + "\n" + prose(40), "en", "ab"[i % 2]) for i in range(200)]
    rows += [(300 + i, prose(50) + "\n" + passage, "en", "a") for i in range(8)]
    rows += [(400 + i, rows[i][1], "en", "b") for i in range(20)]
    rows += [(500 + i, rows[i + 50][1].replace(" ", " \t", 1) + " " + word(), "en", "b") for i in range(20)]
    rows += [(600, prose(30) + " " + item.upper() + ", " + prose(30), "en", "a"), (700, "123 456", "en", "a"), (701, None, "en", "a"), (702, "", None, None)]
    docs, sf_dir = frame(rows), f"{shared_folder(spark)}/pipeline-test"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns) - 1] == docs.columns[:-1] or "copies" in out.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert {700, 701, 702}.isdisjoint(seen["language ID"]) and len(seen["language ID"]) == len(rows) - 3
    lines = seen["line dedup"]
    assert len(lines) == len(rows) - 3 and sum(passage in r["text"] for r in lines.values()) == 1 and passage in lines[300]["text"]
    assert set(seen["SimHash near-dedup"]) == {*range(200), *range(300, 308), 600}
    assert set(seen["benchmark decontamination"]) == {*range(200), *range(300, 308)}
    last = seen["mixing sources"]
    before = seen["benchmark decontamination"]
    assert all(r["copies"] in (1, 2) and r["text"] == before[i]["text"] for i, r in last.items())
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert abs(sum(words(r) * r["copies"] for r in last.values()) / sum(map(words, before.values())) - 1.5) < 0.02


def test_run_reads_documents(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]


def test_passage_of_two_documents_stays_in_one(spark, frame):
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(6)) for _ in range(n))
    passage = prose(60)
    docs = frame([(i, f"{prose(90)}\n{passage}\n{prose(40)}", "en", "a") for i in range(2)])
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.simhash_near_dedup):
        docs = stage(spark, docs, "")
    assert sorted((r["doc_id"], passage in r["text"]) for r in docs.collect()) == [(0, True), (1, False)]


def test_decontamination_learns_from_all_documents(spark, frame, monkeypatch):
    """The latent space is fitted on every document that reaches the stage, however many there are."""
    from pyspark.sql import functions as F

    from tideline.llm import latent

    tables = {}
    monkeypatch.setattr(latent, "written", lambda df, name="step", plain=latent.written: tables.setdefault(name, plain(df, name)))
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(6)) for _ in range(60)]
    docs, sf_dir = frame([(i, " ".join(rng.choices(words, k=50)), "en", "a") for i in range(3000)]), f"{shared_folder(spark)}/pipeline-all-test"
    spark.createDataFrame([(1, " ".join(words[:30]))], "item_id bigint, text string").write.mode("overwrite").parquet(f"{sf_dir}/benchmark.parquet")
    assert corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir).count() == 3000
    got = tables["numbered"].agg(F.sum("n"), F.sum(F.octet_length("sizes"))).first()
    assert tuple(got) == (3000, 6000)  # two passages a document
