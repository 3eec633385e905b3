import functools
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tideline.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return al.Vocabulary(A), al.Vocabulary(B)


@functools.cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def pieces(text):
    """(id, first byte, end byte) of the tokens of A and of B, by the libraries alone; None where they do not give back the text."""
    t, s = libraries()
    of = al.byte_level()
    out = []
    for ids, spell in ((t.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(of[c] for c in t.id_to_token(i))), (s.encode(text), lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode())):
        rows, at = [], 0
        for i in ids:
            rows.append((i, at, at + len(spell(i))))
            at = rows[-1][2]
        if b"".join(map(spell, ids)) != (" " + text).encode():
            return None
        out.append(rows)
    return out


def brute(rows):
    """The whole result, from byte ranges by all pairs of tokens that overlap."""
    docs, total = [], Counter()
    for i, text, *_ in rows:
        a, b = pieces(text) or ([], []) if text else ([], [])
        links, start = [], 0
        for x, p, q in a:
            while start < len(b) and b[start][2] <= p:
                start += 1
            j = start
            while j < len(b) and b[j][1] < q:
                links.append((x, b[j][0]))
                j += 1
        cuts = {q for _, _, q in a} & {q for _, _, q in b}
        groups, now = [], ([], [])
        events = sorted([(q, 0, x) for x, _, q in a] + [(q, 1, x) for x, _, q in b])
        for n, (q, side, x) in enumerate(events):
            now[side].append(x)
            if q in cuts and (n + 1 == len(events) or events[n + 1][0] > q):
                groups.append("|".join(",".join(map(str, v)) for v in now))
                now = ([], [])
        docs.append((i, len(a), len(b), groups, links))
        total.update(links)
    top = {}
    for (_, y), n in total.items():
        top[y] = max(n, top.get(y, 0))
    return sorted(
        str((i, a, b, len(g), len(x), sum(total[p] == top[p[1]] for p in x), sum(total[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")) for i, a, b, g, x in docs
    )


def found(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(str(tuple(r)) for r in df.collect())


ALPHABET = ["the ", "Haus", " straße", "été", "漢字", "🎈", "<|endoftext|>", "<s>", "\n", "  ", "\t", "12", "3.5", "don't", "▁", "́", " ", "x", "ing", ", ", "\x01", "​"]


def random_texts(seed, n, longest):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(1, longest))) for _ in range(n)]


def test_odd_rows(spark, frame, odd):
    """Nulls, empty and long texts, repeated rows, special strings; a word of one letter and a text of spaces only."""
    rows = [r if r[1] is None or len(r[1]) < 60_000 else (r[0], r[1][:30_000], *r[2:]) for r in odd]
    rows += [(20, "a <|endoftext|> b <s> c </s>", "en", "a"), (21, "   ", "en", "a"), (22, "▁a ▁▁ b", "en", "a"), (23, "x", None, None)]
    assert found(al.align_documents(frame(rows), A, B)) == brute(rows)


def test_random_texts_in_several_chunks(spark, frame):
    """Small chunks; copies of a text weigh its pairs."""
    texts = random_texts(1, 60, 60) + ["the same text"] * 9
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    assert found(al.align_documents(frame(rows), A, B, chunk=500)) == brute(rows)


def test_empty_table(spark, frame):
    assert al.align_documents(frame([]), A, B).count() == 0


def test_hot_copies(spark, frame):
    rows = [(i, "copied words here" if i % 3 else f"own text {i}", "en", "a") for i in range(3500)]
    assert found(al.align_documents(frame(rows), A, B)) == brute(rows)


def test_lanes_change_nothing(both, monkeypatch):
    texts = [" ".join(random_texts(2, 300, 9)), *random_texts(3, 20, 40), "", "x" * 3000]
    digits = al._digits(60_000)
    one = al.align(*both, texts, digits, True)
    monkeypatch.setattr(al, "LANE", 7)
    monkeypatch.setattr(al, "NEAR", 5)
    short = al.align(*both, texts, digits, True)
    assert all(np.array_equal(one[k], short[k]) for k in ("n_a", "n_groups", "n_links", "sha", "kinds", "groups"))
    count = lambda out: sorted(zip(np.repeat(np.arange(len(texts)), out["kinds"]), out["pairs"][out["pair"]], out["often"], strict=True))
    assert count(one) == count(short)


def test_ids_are_the_library_s(both):
    """Every character of the first two planes in several surroundings, random texts, and very long pieces."""
    slow = al.Vocabulary(A, fast=False)
    points = [c for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2{chr(c)}{chr(c)}.\n{chr(c)} x" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    texts += random_texts(4, 500, 30) + ["x" * 50_000, " " * 4_990, " " * 100_000 + "a", "漢" * 20_000, "\n" * 30_000 + "a", "!?" * 20_000]
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        assert all(np.array_equal(x, y) for x, y in zip(both[0].ids(part), slow.ids(part), strict=True))


def test_other_vocabularies_use_their_library():
    v = al.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert v.ids(["Some words"])[0].tolist() == al.Vocabulary(public_tokenizers.path("word_bpe_49k.json"), fast=False).ids(["Some words"])[0].tolist()


def test_packing():
    pair, often = np.array([0, 5, 9, 2, 2, 70_000]), np.array([1, 2, 1, 9, 1, 3])
    assert [x.tolist() for x in al._unpacked(al._packed(pair, often), 6)] == [pair.tolist(), often.tolist()]
