import uuid

import public_tokenizers
import pytest

from tideline.llm import token_cache as tc
from tideline.session import shared_folder

JSON = public_tokenizers.path("byte_bpe_50k.json")


def place(spark):
    return f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"


def plain(path, text):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, frame, odd, name):
    path = public_tokenizers.path(name)
    rows = [*odd, (20, "a <|endoftext|> b <s> c", "en", "a")]
    got = tc.count_tokens(frame(rows), path, place(spark)).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got) == sorted(str((i, len((t or "").encode()), plain(path, t))) for i, t, _, _ in rows)


def test_only_distinct_misses_are_encoded_and_appended(spark, frame, odd):
    cache = place(spark)
    tc.count_tokens(frame(odd), JSON, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t, _, _ in odd})
    key = tc.tokenizer_digest(JSON)
    more = frame([*odd, (30, "new text", "en", "a"), (31, "new text", "en", "a")])
    assert [r["content"] for r in tc.misses(more, tc.read_cache(spark, cache, key)).collect()] == ["new text"]
    assert tc.count_tokens(more, JSON, cache).where("n_tokens IS NULL").count() == 0
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).select("digest").distinct().count() == len({t or "" for _, t, _, _ in odd}) + 1
    assert tc.read_cache(spark, cache, "another tokenizer").count() == 0


def test_empty_table(spark, frame):
    assert tc.count_tokens(frame([]), JSON, place(spark)).count() == 0
