import random
import zlib

import pytest

from tideline.llm import langid

PARTS = {"xx": ["ba", "do", "ki", "mu"], "yy": ["shr", "tel", "on", "ix"], "zz": ["äö", "ße", "il", "ba"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def learned(frame):
    rng = random.Random(1)
    return frame([(i, text(rng, lang), lang, "a") for i, lang in enumerate(["xx", "yy", "zz"] * 60)])


def test_held_out_accuracy_and_unseen_words(spark, frame, learned):
    model = langid.fit(learned)
    rng = random.Random(2)
    new = [(1000 + i, text(rng, lang, 12).upper(), lang, None) for i, lang in enumerate(["xx", "yy", "zz"] * 20)]
    got = {r["doc_id"]: r for r in langid.predict(frame(new), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 < got[i]["score"] <= 1 for i, _, lang, _ in new)
    assert langid.Scorer(model)("shrtelonixshr")[0] == "yy"  # no such word was learned


def test_backing_off_takes_the_longest_known_gram():
    model = langid.Model(["a", "b"], [("a", "word", 3)], [("a", " x", 2), ("b", "x", 5), ("a", "xyz ", 1)])
    assert [model.places("xyz")[k] == model.gram_at[g] for k, g in ((0, " x"), (1, "xyz "))] == [True, True]
    assert model.places("xq") == [model.gram_at[" x"], model.gram_at["x"], 0]


def test_scores_by_hand():
    model = langid.Model(["a", "b"], [("a", "word", 9), ("b", "word", 1), ("b", "other", 8)], [])
    lang, score = langid.Scorer(model)("word word, other")
    import math

    a = (2 * math.log(9.1 / 9.2) + math.log(0.1 / 9.2)) / 3
    b = (2 * math.log(1.1 / 9.2) + math.log(8.1 / 9.2)) / 3
    assert lang == ("a" if a > b else "b") and abs(score - 1 / (1 + math.exp(-abs(a - b) * 3))) < 1e-9


def test_forgetting_unseen_words_changes_nothing(learned, monkeypatch):
    model = langid.fit(learned)
    rng = random.Random(3)
    texts = ["".join(rng.choice("badokimushrtelx ") for _ in range(200)) for _ in range(60)]
    want = [langid.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(langid, "KEPT", 5)
    few = langid.Scorer(model)
    assert [few(t) for t in texts] == want


def test_odd_rows_and_never_learning_from_held_out_ones(spark, frame, learned, odd):
    model = langid.fit(learned)
    got = langid.predict(frame(odd), model).collect()
    assert len(got) == len(odd)
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(str(i) for i in und) == ["1", "2", "3", "9", "None"] and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert langid.fit(frame([(i, "only held out", "qq", "a") for i in held])).langs == []
    assert langid.predict(frame(odd), langid.fit(frame([]))).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(frame([]), model).count() == 0


def test_rejecting_keeps_clean_rows_and_all_columns(spark, frame, learned):
    extra = frame([(900, None, "xx", "a"), (901, "12 34", "xx", "a"), (902, "", None, None)])
    out = langid.reject_unknown(learned.unionAll(extra))
    assert out.schema == learned.schema and out.count() == learned.count()
    assert langid.reject_unknown(frame([])).count() == 0


def test_one_id_on_many_rows(frame):
    """Repeats of an id neither empty the sample nor multiply it."""
    from tideline.llm.common import bounded_sample

    rows = [(i, f"text {k}", "en", "a") for i in (1, 11) for k in range(2000)] + [(11, "text 0", "en", "a")] * 500
    df = frame(rows).selectExpr("doc_id", "xxhash64(text) AS row", "lang")
    got = [tuple(r) for r in bounded_sample(df, "lang", 300).collect()]
    assert len(got) == 300 == len(set(got)) and {r[2] for r in got} == {"en"} and {r[0] for r in got} == {1, 11}
    assert bounded_sample(df, "lang", 9000).count() == 4000


def test_counts_come_from_all_labelled_rows(frame, monkeypatch):
    """A word that only one of more than 2,000 texts has is counted, wherever it stands, and so is every repeat."""
    monkeypatch.setattr(langid, "COUNTED", 50)
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"common own{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}", "en", "a") for k, i in enumerate(ids)]
    words = {r["word"]: r["n"] for r in langid._word_counts(frame(rows).selectExpr("lang AS label", "text")).collect()}
    assert words["common"] == len(ids) > 4000 and len(words) == len(ids) + 1
    twice = langid.fit(frame([*rows, *rows]))
    assert len(twice.word_at) == len(ids) + 1 and langid.fit(frame(rows)).word_at == {"common": 0}


def test_grams_are_counted_once_a_place(frame):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    model, n = langid.fit(frame([(i, *x, "a") for i in ids for x in (("ab c ab", "en"), ("zz", "xx"))])), len(ids)
    en = {"a": 2, "b": 2, "c": 1, " ": 6, " a": 2, "ab": 2, "b ": 2, " c": 1, "c ": 1, " ab": 2, "ab ": 2, " c ": 1, " ab ": 2}
    xx = {"z": 2, " ": 2, " z": 1, "zz": 1, "z ": 1, " zz": 1, "zz ": 1, " zz ": 1}
    only = langid.Model(["en", "xx"], [], [(lang, g, k * n) for lang, grams in (("en", en), ("xx", xx)) for g, k in grams.items()])
    assert set(model.gram_at) == set(only.gram_at) == en.keys() | xx.keys()
    assert all((model.gram_rows[model.gram_at[g]] == only.gram_rows[only.gram_at[g]]).all() for g in only.gram_at)
