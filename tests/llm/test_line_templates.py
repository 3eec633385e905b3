import random
import re
from collections import Counter, defaultdict

from tideline.llm import line_templates as lt


def brute(rows, least):
    """(doc_id, text) after dropping, by the rules stated in the module."""
    lines, leaves, weights = [], defaultdict(set), defaultdict(Counter)
    for r, (i, t, _, _) in enumerate(rows):
        for at, raw in enumerate((t or "").split("\n") if t is not None else []):
            tokens = re.findall(r"[^\x20\x09-\x0D]+", raw)
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in tokens)
            if tokens:
                leaf = (len(tokens), tokens[:3])
                lines.append((r, at, i, leaf, tokens))
                leaves[leaf].add(i)
                weights[leaf][tokens] += 1
    template = {}
    groups = {(leaf,): dict(ws) for leaf, ws in weights.items() if len(leaves[leaf]) >= least}
    while groups:
        deeper = defaultdict(dict)
        for name, ws in groups.items():
            total = sum(ws.values())
            if len(ws) == 1 or total < least:
                continue
            c = Counter()
            for tokens, n in ws.items():
                for k in range(3, len(tokens)):
                    c[k, tokens[k]] += n
            for tokens, n in ws.items():
                own = [(k, tokens[k]) for k in range(3, len(tokens))]
                if 2 * sum(2 * c[p] > total for p in own) >= len(own):
                    template[tokens] = name
                elif split := [p for p in own if least <= c[p] <= total / 2]:
                    deeper[(*name, max(split, key=lambda p: (c[p], -p[0])))][tokens] = n
        groups = deeper
    for ws in weights.values():
        for tokens in ws:
            template.setdefault(tokens, tokens)
    docs = defaultdict(set)
    for _, _, i, _, tokens in lines:
        docs[template[tokens]].add(i)
    lost = defaultdict(set)
    for r, at, i, _, tokens in lines:
        ids = docs[template[tokens]]
        if len(ids) >= least:
            known = [x for x in ids if x is not None]
            if known and i != min(known):
                lost[r].add(at)
    return [(i, None if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in lost[r])) for r, (i, t, _, _) in enumerate(rows)]


def check(frame, rows, least=3):
    df = frame(rows)
    out = lt.drop_recurring(df, least)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, least)))
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    return dict(got)


LOG = "worker has finished job {} in {} seconds on node {} without errors today"


def test_templates_with_variable_fields(frame):
    rows = [(i, f"own text {chr(97 + i)} of this document alone\n{LOG.format(chr(97 + i), i, 'n' + str(i))}\n\nend {chr(97 + i)}", "en", "a") for i in range(9)]
    got = check(frame, rows)
    assert "finished" in got[0] and all("finished" not in got[i] for i in range(1, 9))
    assert all("own text" in t for t in got.values())


def test_long_passages_shared_by_documents(frame):
    passage = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, f"intro of {'abcdefghij'[i]} here\n{passage}\n{'abcdefghij'[i]} outro", "en", "a") for i in range(10)]
    got = check(frame, rows, 5)
    assert sum(passage in t for t in got.values()) == 1 and passage in got[0]


def test_close_lines_in_one_leaf_join_and_distant_ones_do_not(frame):
    near = [(i, " ".join(["the", "same", "head", *["common"] * 16, f"x{'abcdefgh'[i]}"]), "en", "a") for i in range(8)]
    far = [(20 + i, " ".join(["the", "other", "head", *[chr(97 + (7 * i + k) % 26) * 3 for k in range(17)]]), "en", "a") for i in range(8)]
    got = check(frame, near + far)
    assert [bool(got[i]) for i in range(8)] == [True] + [False] * 7 and all(got[20 + i] for i in range(8))


def word(k):
    return "".join(chr(97 + (k * 7 + j * k * k) % 26) for j in range(5)) + chr(97 + k % 26) + chr(97 + k // 26)


def test_two_word_fields(frame):
    got = check(frame, [(i, f"the job of {word(i)} was started by {word(500 + i)}", "en", "a") for i in range(60)], 5)
    assert [i for i in range(60) if got[i]] == [0]


def test_several_templates_share_a_leaf(frame):
    """Three templates of equal size, and one of few lines that differ from the many others by two tokens."""
    kinds = ["the job of {} was done without any fault", "the job of {} has come to some end", "the job of {} will wait for more room"]
    rows = [(i, kinds[i % 3].format(word(i)), "en", "a") for i in range(60)]
    got = check(frame, rows, 5)
    assert [i for i in range(60) if got[i]] == [0, 1, 2]
    noise = [(100 + i, f"the job of {word(i)} {word(90 + i)} {word(190 + i)} {word(290 + i)} {word(390 + i)} {word(490 + i)}", "en", "a") for i in range(80)]
    got = check(frame, [*rows, *noise], 5)
    assert [i for i in range(60) if got[i]] == [0, 1, 2] and all(got[100 + i] for i in range(80))
    small = [(200 + i, f"the job of {word(i)} was {word(90 + i)} under heavy load", "en", "a") for i in range(7)]
    got = check(frame, [*rows, *noise, *small], 5)
    assert sum(bool(got[200 + i]) for i in range(7)) == 1 and all(got[100 + i] for i in range(80))


def test_random_leaves_equal_brute_force(frame):
    rng = random.Random(5)
    for size in (2, 3, 6):
        rows = [(i, "\n".join(" ".join(["a", rng.choice("ab"), "c", *(rng.choice("defghi"[:size]) * 2 for _ in range(rng.choice((1, 4, 7))))]) for _ in range(6)), "en", "a") for i in range(60)]
        check(frame, rows, 4)


def test_a_hot_token_is_dealt_out(frame, monkeypatch):
    from tideline.llm import common

    monkeypatch.setattr(common, "HEAVY", 5)
    test_several_templates_share_a_leaf(frame)


def test_columns_named_like_the_counts(spark):
    df = spark.createDataFrame([(i, "same line of words", 7, i) for i in range(6)], "doc_id bigint, text string, n_lines int, n_dropped int")
    out = lt.drop_recurring(df)
    assert out.columns == df.columns and {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == {(0, 1, 0), *((i, 1, 1) for i in range(1, 6))}
    for f in (lt.drop_recurring, lt.drop_passages):
        out = f(df, counts=False)
        assert out.columns == df.columns and {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == {(i, 7, i) for i in range(6)}


def test_odd_rows(frame, odd):
    more = [(i, "x\n\n \n", "en", "a") for i in (40, 41, 42, None)] + [(50, "same\nsame\nsame", "en", "a"), (51, "same", "en", "a"), (52, " same\t", "en", "a")]
    check(frame, [*odd, *more])
    assert lt.drop_recurring(frame([])).count() == 0
    nulls = [(None, f"only null ids\n{k}", "en", "a") for k in "abc"]
    check(frame, nulls, 1)


def test_main_path_is_native(frame):
    assert "Python" not in lt.drop_recurring(frame([(1, "a b", "en", "a")]))._jdf.queryExecution().executedPlan().toString()


def test_passages_of_two_documents(frame):
    """Over 50 tokens from two documents on; shorter lines, and repeats within one document, stay."""
    words = lambda c, n: " ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    two, four, short, own = words("t", 51), words("f", 60), words("s", 50), words("o", 70)
    rows = [(i, "\n".join([f"intro {'abcdef'[i]}", *[two] * (i in (1, 4)), *[four] * (i in (0, 2, 3, 5)), short, *[own] * (2 * (i == 2))]), "en", "a") for i in range(6)]
    out = lt.drop_passages(frame([*rows, (None, two, "en", "a"), (7, None, "en", "a")]))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [i for i in range(6) if two in got[i]] == [1] and [i for i in range(6) if four in got[i]] == [0]
    assert all(short in got[i] for i in range(6)) and got[2].count(own) == 2 and got[None] == "" and got[7] is None
