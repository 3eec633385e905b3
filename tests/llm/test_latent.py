import random

import pytest

from tideline.llm import latent


@pytest.fixture
def corpus(spark, frame):
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("bcdfgklmnprstaeiou") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    items = [(100 + k, prose(rng.randint(15, 60))) for k in range(30)]
    rows, leaks = [], set()
    for i in range(300):
        ws = prose(rng.randint(30, 400))
        if i % 10 == 0:
            item, text = items[i // 10]
            text = list(text)
            if i % 20 == 0:  # a paraphrase: one word in eight replaced, but not the last three
                for k in range(0, len(text) - 3, 8):
                    text[k] = word()
            at = rng.randrange(len(ws))
            ws[at:at] = [w.upper() + ("," if rng.random() < 0.2 else "") for w in text]
            leaks.add((i, item))
        rows.append((i, " ".join(ws).replace(" the ", "\n", 1), "en", "a"))
    bench = spark.createDataFrame([(k, " ".join(t).capitalize() + ".", "x") for k, t in items], "item_id bigint, text string, doc_id string")
    return frame(rows), bench, leaks


def test_finds_exact_and_paraphrased_items_and_nothing_else(corpus):
    docs, bench, leaks = corpus
    got = latent.matches(docs, latent.prepare(docs, bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == leaks
    kept = latent.without_benchmark(docs, bench)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == set(range(300)) - {i for i, _ in leaks}


def test_blocks_of_items_give_the_same(corpus):
    docs, bench, leaks = corpus
    blocks = latent.prepare(docs, bench, block=10)
    assert len(blocks) == 3 and sum(len(b.items) for b in blocks) == 30
    assert {(r["doc_id"], r["item_id"]) for r in latent.matches(docs, blocks).collect()} == leaks


def test_candidates_come_from_the_latent_space(corpus):
    """Without a latent space nothing is found; a place that is unlike its item there is no candidate."""
    docs, bench, leaks = corpus
    blocks = latent.prepare(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in latent.matches(docs, blocks).collect()} == leaks
    for one in blocks:
        one.settle(0 * one.space)
    assert latent.matches(docs, blocks).count() == 0


def test_likeness_is_that_of_the_best_window_around_a_start(corpus):
    docs, bench, _ = corpus
    one = latent.prepare(docs, bench)[0]
    one.seed(0.6)
    rng = random.Random(3)
    for k, (_, ws, _) in enumerate(one.items[:10]):
        words = [rng.choice(list(one.terms)) for _ in range(300)] + ws + [rng.choice(list(one.terms)) for _ in range(100)]
        starts = [0, 16, 32, 160, *range(256, 336, 16)]
        n, step = len(ws), max(1, len(ws) // 8)
        unit = lambda v: v / max((v @ v) ** 0.5, 1e-9)
        for s, got in zip(starts, one.likeness(words, k, starts), strict=True):
            base = max(0, (s if s in (0, 160, 256) else 0 if s < 160 else 256) - n)
            grid = [p for p in range(base, s + latent.WINDOW + 1, step) if p >= max(0, s - n)]
            want = max(float(unit(one.space[one.rows(words[p : p + n])].astype(float).sum(0)) @ one.vectors[k]) for p in grid)
            assert got == pytest.approx(want, abs=1e-6)


def test_windows_find_what_brute_force_over_all_windows_finds(corpus):
    """Recall of the retrieval: items whose words a document holds in full, wherever they start."""
    docs, bench, _ = corpus
    one = latent.prepare(docs, bench)[0]
    one.seed(0.6)
    rng = random.Random(2)
    for item, ws, _ in one.items:
        for pad in (0, 5, 17, 31, 40):
            text = " ".join(["zzz"] * pad + ws + ["qqq"] * rng.randint(0, 50))
            assert item in [m[0] for m in one.find(text, 0.4, 0.6, 0.8)]


def test_seeds_lose_nothing_that_the_last_check_would_pass(corpus):
    """Texts that hold at least the share of an item, at random: its place is always found."""
    docs, bench, _ = corpus
    one = latent.prepare(docs, bench)[0]
    one.seed(0.6)
    rng = random.Random(5)
    for k, (_, ws, _) in enumerate(one.items):
        for _ in range(20):
            kept = sorted(rng.sample(range(len(ws)), -(-6 * len(ws) // 10)))
            text = ["zzz"] * 30 + [ws[i] if i in kept else "qqq" for i in range(len(ws))]
            assert k in one.places(text)


def test_common_subsequence_by_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert latent.common_subsequence(a, b) == table[-1][-1]


def test_answers_decide_between_paraphrase_and_likeness():
    assert latent.answer_of("What is it? Answer: forty two") == ["forty", "two"]
    one = latent.Block([(1, " ".join(f"w{k}" for k in range(20)))])
    one.weigh({}, 10)
    import numpy as np

    one.settle(np.eye(len(one.terms)))
    one.seed(0.6)
    like = [f"w{k}" for k in range(14)]
    assert one.find(" ".join(like), 0.4, 0.6, 0.8) == []
    assert one.find(" ".join([*like, "w17", "w18", "w19"]), 0.4, 0.6, 0.99)[0][0] == 1


def test_odd_rows(spark, frame, odd, corpus):
    _, bench, _ = corpus
    extra = spark.createDataFrame([(None, "short one", "x"), (7, None, "x"), (8, "", "x"), (9, "!!", "x"), (10, "the same text of some words", "x")], bench.schema)
    docs = frame(odd)
    got = latent.matches(docs, latent.prepare(docs, bench.unionAll(extra))).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("6", 10), ("6", 10), ("7", 10), ("None", 10)]
    assert latent.matches(frame([]), latent.prepare(frame([]), bench)).count() == 0
    none = latent.prepare(docs, bench.where("false"))
    assert latent.matches(docs, none).count() == 0 and latent.without_benchmark(docs, bench.where("false")).count() == len(odd)


def test_recall_in_real_documents_is_that_of_brute_force(spark):
    """Items set into documents of all sizes, whole or with words replaced: everything that the subsequence over all places finds."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.01"
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    texts = sorted((r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist() if r["text"]), key=len)
    docs, table = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rng, planted, rows = random.Random(21), [], []
    foreign = [w for t in texts[::50] for w in latent.words_of(t)[:2000]]
    for n in range(900):
        item, text = bench[n % len(bench)]
        ws = latent.words_of(text)
        for k in rng.sample(range(len(ws) - 3), int((len(ws) - 3) * (0, 0.2, 0.35)[n % 3])):
            ws[k] = "qqq" if n % 2 else rng.choice(foreign)
        if n % 5 == 0:  # words put between
            ws = [x for w in ws for x in (w, rng.choice(foreign))[: rng.choice((1, 1, 2))]]
        into = latent.words_of(texts[rng.randrange(len(texts))])
        at = rng.randrange(len(into) + 1)
        planted.append((n, item))
        rows.append((n, " ".join(into[:at] + ws + into[at:])))
    got = latent.matches(spark.createDataFrame(rows, "doc_id bigint, text string"), latent.prepare(docs, table))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    words = {i: (latent.words_of(t), latent.answer_of(t)) for i, t in bench}

    def held(n, item):
        ws, answer = words[item]
        text = latent.words_of(rows[n][1])
        for s in range(0, len(text), 8):
            region = text[s : s + 2 * len(ws)]
            share = latent.common_subsequence(ws, region) / len(ws)
            if share >= 0.8 or share >= 0.6 and latent.common_subsequence(answer, region) == len(answer):
                return True
        return False

    want = {p for p in planted if held(*p)}
    assert len(want) > 800
    assert len(want - found) == 0


def test_space_is_fitted_on_the_passages_of_all_documents(spark, frame, monkeypatch):
    """The leading singular vectors of thousands of documents are those of the whole matrix, not of a sample of it."""
    import numpy as np

    monkeypatch.setattr(latent, "RANK", 6)
    monkeypatch.setattr(latent, "SPARE", 200)  # all dimensions, so that nothing is left to chance
    rng = random.Random(11)
    topics = [[f"{c}{k}" for k in range(12)] for c in "abcdefghij"]
    every = [w for t in topics for w in t]
    texts = []
    for _ in range(5000):
        own = rng.choices(topics, [0.6**k for k in range(10)])[0]
        texts.append(" ".join(rng.choice(own) if rng.random() < 0.3 else rng.choice(every) if rng.random() < 0.1 else "other" for _ in range(rng.randint(0, 120))))
    bench = spark.createDataFrame([(k, " ".join(rng.choices(every, k=40))) for k in range(20)], "item_id bigint, text string")
    one = latent.prepare(frame([(i, t, "en", "a") for i, t in enumerate(texts)]), bench)[0]
    assert len(one.terms) > 100
    passages = [ws[s : s + latent.WINDOW] for ws in map(latent.words_of, texts) for s in range(0, len(ws), latent.WINDOW)]
    passages += [ws[s : s + latent.PASSAGE] for _, ws, _ in one.items for s in (0, latent.PASSAGE) if s < len(ws) - latent.PASSAGE // 2 or s == 0]
    rows = np.array([np.bincount(one.rows(p), minlength=len(one.terms)) for p in passages]) * one.idf
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    want = one.idf[:, None] * np.linalg.eigh(rows.T @ rows)[1][:, -6:]
    want = want @ want.T
    assert np.abs(one.space @ one.space.T - want).max() < 0.02 * np.abs(want).max()


def test_numbers_of_all_documents_are_kept(spark, frame, monkeypatch):
    """Rows of few terms, documents of any length and without words: every word of the benchmark is there, passage by passage."""
    import numpy as np

    monkeypatch.setattr(latent, "ROW", 50)
    one = latent.Block([(1, " ".join(f"w{k}" for k in range(20)))])
    texts = [None, "", *[" ".join(f"w{(i * k) % 30}" for k in range(i)) for i in range(0, 300, 7)]]
    rows = latent._numbered(frame([(i, t, "en", "a") for i, t in enumerate(texts)]).coalesce(1), one).collect()
    sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in rows])
    terms = np.concatenate([np.frombuffer(r["terms"], np.uint16) for r in rows])
    want = [[one.terms[w] for w in ws[s : s + latent.WINDOW] if w in one.terms] for ws in map(latent.words_of, texts) for s in range(0, len(ws), latent.WINDOW)]
    assert len(rows) > 1 and sizes.tolist() == [len(p) for p in want] and terms.tolist() == [t for p in want for t in p]
    df, n = latent._frequencies(spark.createDataFrame(rows, "n bigint, df binary, terms binary, sizes binary"), one)
    assert n == len(texts) and df == {w: c for w in one.terms if (c := sum(w in latent.words_of(t) for t in texts))}
