import random

import pytest

from tideline.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance(monkeypatch):
    words = ["grolch", "blarf", "snurgle", "spleenwort", "abc", "grole"]
    rng = random.Random(4)
    tries = ["".join(rng.choice("grolchbafsnuepwt") for _ in range(rng.randint(0, 11))) for _ in range(3000)]
    for w in words * 60:
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda k=k, w=w: w.insert(k, rng.choice("abcx")), lambda k=k, w=w: w[k : k + 1].clear() or w.pop(min(k, len(w) - 1)) if w else None, lambda k=k, w=w: w.__setitem__(min(k, len(w) - 1), "x") if w else None])()
        tries.append("".join(w))
    allowed = {w: 0 if len(w) < 5 else 1 if len(w) < 9 else 2 for w in words}
    monkeypatch.setattr(tox, "STATES", 50)  # forgets and starts anew
    a = tox.Automaton(words, [])
    for t in tries:
        want = "words" if t in words else "fuzzy" if any(distance(t, w) <= k for w, k in allowed.items()) else None
        assert a.look_up(t) == want, t


def test_stems_and_windows():
    s = tox.Scorer(tox.Lexicon(["grolch"], ["snur"]))
    f = dict(zip(tox.FEATURES, s.features('You grolch! She said "snurbel and" grolsh snurfff').round(3), strict=True))
    import math

    assert f["quoted"] > 0 and f["reported"] > 0 and f["addressed"] > 0 and f["crowded"] > 0
    quoted, plain = s('they said "a grolch" once'), s("what a grolch here")
    assert quoted < plain and s("a clean text") < 0.1 < 0.5 < plain
    assert s("what a grollch here") > 0.5 and s(None) == s("") and math.isfinite(s("grolch " * 50_000))
    assert s.kind("snurbel") == "stems" and s.kind("snur") == "stems" and s.kind("snow") is None


@pytest.fixture
def labelled(spark, frame):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "ne", "ri", "so", "lu"]) for _ in range(rng.randint(1, 4)))
    bad = ["grolch", "blarfo", "snurgle", "vexaba", "vexune", "vexilo", "vexory"]
    rows, labels = [], []
    for i in range(600):
        ws = [word() for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.sample(range(60), 5):
                ws[k] = rng.choice(bad)
        rows.append((i, " ".join(ws), "en", "a"))
        labels.append((i, 1, int(toxic)))
    return frame(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_words_and_stems_and_predicts_held_out_rows(labelled):
    docs, labels = labelled
    lexicon = tox.fit(docs, labels)
    assert {"grolch", "blarfo", "snurgle"} <= set(lexicon.words) and not set(lexicon.words) - {"grolch", "blarfo", "snurgle", "vexaba", "vexune", "vexilo", "vexory"}
    rows = tox.score(docs, lexicon).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 6 == 0) for r in rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, frame, labelled, odd):
    docs, labels = labelled
    twice = labels.unionAll(spark.createDataFrame([(None, 1, 1), (0, None, None), (3, 1, 0)], labels.schema))
    lexicon = tox.fit(docs.unionAll(frame(odd)), twice)
    got = tox.score(frame(odd), lexicon).collect()
    assert len(got) == len(odd) and all(r["score"] < 0.5 for r in got)
    empty = tox.fit(docs, labels.where("false"))
    assert empty.words == [] and tox.score(docs, empty).where("score >= 0.5").count() == 0
    assert tox.score(frame([]), lexicon).count() == 0


def test_misspelt_first_letters_of_words_with_a_stem(spark, frame):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(600):
        ws = ["".join(rng.choice(["ta", "ne", "ri", "so", "lu"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        if i % 6 == 0:
            for k in rng.sample(range(60), 8):
                ws[k] = rng.choice(["idiot", "idiots", "idiotic", "idiocy"])
        rows.append((i, " ".join(ws), "en", "a"))
        labels.append((i, 1, int(i % 6 == 0)))
    lexicon = tox.fit(frame(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert "idio" in lexicon.stems
    s = tox.Scorer(lexicon)
    assert s.kind("idiotical") == "stems" and [s.kind(w) for w in ("idot", "iidiot", "xdiot", "odiotic")] == ["fuzzy"] * 4 and s.kind("radio") is None
