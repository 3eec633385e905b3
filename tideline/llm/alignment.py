"""Alignment of two tokenizers' tokens by the bytes they stand for.

Both tokenizers encode a text; their tokens' ends are byte offsets into the same bytes. A lane is a
stretch of one document between two offsets where a token of A and a token of B both end. All lanes of a chunk
advance in lockstep: one NumPy state vector holds each lane's place in A and in B, a step links the
two tokens there, cuts where both end together, moves the pointer whose token ends first (both at a
cut), and lanes that are done leave the vector. A document is split into lanes of about ``LANE`` tokens where it has a
shared end near by, so that one very long text does not keep a nearly empty vector going.

Links give the pairs of ids and how often each pair is linked in the whole corpus. Counts come from one row for each
chunk and pair; chunks get the counts of their own pairs back, so single links never move.

Scale: texts are encoded once for each distinct content, whose copies only weigh its counts. Chunks
hold whole texts of ``CHUNK`` characters or one longer text; a group of copies or a very common pair of tokens is
one row a chunk at most, and documents find their text's result by a salted lookup.

Defined results: null and empty texts, and texts whose joined token bytes do not equal a space and the text, have no
tokens: zeros, and an empty string in place of the digest. Rows that repeat an id or a text each get
the text's result. Texts of any length are encoded whole. An empty table gives an empty result. Further
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import salted_lookup
from tideline.session import written

#: Characters of a chunk, and of one call of a tokenizer (a longer text goes alone).
CHUNK, CALL = 2_000_000, 400_000
#: Tokens of A in a lane, about, and how far a shared end is looked for.
LANE, NEAR = 512, 64
#: A pair of ids is one number: A's id times this plus B's id.
WIDE = 1 << 24


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, other bytes follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how byte-level vocabularies cut a text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BLANK = re.compile(r"\s{5000}")


def _by_ranks(spec: dict, pieces: dict[int, bytes]):
    """A faster encoder with the same ids for a plain byte-level vocabulary whose ids follow its merges, or None.

    Its tests hold it against the vocabulary's own library over every character.
    """
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks={pieces[i]: i for i in model["vocab"].values()}, special_tokens={})


class Vocabulary:
    """A tokenizer with the bytes of its tokens; ``lead`` is what a text gets in front before it is encoded."""

    def __init__(self, path: str, fast: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t, decode = Tokenizer.from_file(path), byte_level()
            t.no_truncation()
            t.no_padding()
            t.encode_special_tokens = True
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            added = {x["content"] for x in spec.get("added_tokens", [])}
            pieces = {i: p.encode() if p in added or any(c not in decode for c in p) else bytes(decode[c] for c in p) for p, i in t.get_vocab().items()}
            ranks = _by_ranks(spec, pieces) if fast else None
            by_library = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            # the faster encoder gives up within very long runs of white space
            self.encode = (lambda texts: [by_library([x])[0] if BLANK.search(x) else ranks.encode_ordinary(x) for x in texts]) if ranks else by_library
            self.lead = " "
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = {i: bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())}
            self.encode = lambda texts: s.encode(texts, num_threads=1)
            self.lead = ""
        of = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.length = np.array([len(p) for p in of], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)[:-1]]
        self.bytes = np.frombuffer(b"".join(of), np.uint8)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.encode([self.lead + t for t in texts])]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.start[ids], self.length[ids])]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first, first + 1, ... of each pair."""
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def lanes(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of A and B of each lane of a document with tokens: after shared ends about LANE tokens apart."""
    if len(end_a) <= LANE + NEAR:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    tries = np.arange(LANE, len(end_a) - 1, LANE)[:, None] + np.arange(NEAR)
    tries = np.minimum(tries, len(end_a) - 2)
    at = np.searchsorted(end_b, end_a[tries])
    same = end_b[at] == end_a[tries]
    row = np.flatnonzero(same.any(1))
    col = same[row].argmax(1)
    a, b = tries[row, col] + 1, at[row, col] + 1
    a, once = np.unique(a, return_index=True)
    return np.r_[0, a], np.r_[0, b[once]]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, a: np.ndarray, b: np.ndarray, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A, in B) and cuts (places in A of tokens that end together with one of B) of all lanes.

    A lane goes from its places ``a`` and ``b`` to the cut at ``last_a``; the ends grow within a lane.
    """
    a, b, links_a, links_b, cuts = a.copy(), b.copy(), [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        x, y = end_a[a], end_b[b]
        cut = x == y
        cuts.append(a[cut])
        go = ~(cut & (a == last_a))
        up_a, up_b = a + (x <= y), b + (y <= x)
        if go.all():
            a, b = up_a, up_b
        else:
            a, b, last_a = up_a[go], up_b[go], last_a[go]
    none = [np.empty(0, np.int64)]
    return tuple(np.concatenate(v or none) for v in (links_a, links_b, cuts))


def _digits(limit: int) -> np.ndarray:
    """Row i: the decimal digits of i as bytes, with zero bytes in front."""
    width = len(str(limit - 1))
    return np.frombuffer(b"".join(str(i).encode().rjust(width, b"\0") for i in range(limit)), np.uint8).reshape(limit, width)


def spelled(ids_a, ids_b, group_a, group_b, doc_a, doc_b, docs: int, digits: np.ndarray) -> list[bytes]:
    """The groups of each document: A's ids by commas, a bar, B's ids, and semicolons between groups.

    The groups of all documents are numbered through in order, so both token lists are sorted by them.
    """
    if not len(ids_a):
        return [b""] * docs
    # a token stands after all tokens of earlier groups, and those of B after A's of their own group
    before_a = np.r_[0, np.cumsum(np.bincount(group_b))][group_a] + np.arange(len(ids_a))
    before_b = np.cumsum(np.bincount(group_a))[group_b] + np.arange(len(ids_b))
    n, width = len(ids_a) + len(ids_b), digits.shape[1]
    cells = np.empty((n, width + 1), np.uint8)
    cells[before_a, :width], cells[before_b, :width] = digits[ids_a], digits[ids_b]
    cells[before_a, width] = np.where(np.r_[group_a[1:] != group_a[:-1], True], ord("|"), ord(","))
    last = np.r_[group_b[1:] != group_b[:-1], True]
    end = np.r_[doc_b[1:] != doc_b[:-1], True]  # no semicolon after a document's last group
    cells[before_b, width] = np.where(end, 0, np.where(last, ord(";"), ord(",")))
    wide = (digits != 0).sum(1) + 1  # with what follows the number
    sizes = np.bincount(doc_a, wide[ids_a], minlength=docs) + np.bincount(doc_b, wide[ids_b] - end, minlength=docs)
    cells = cells.ravel()
    text, at = cells[cells != 0].tobytes(), np.r_[0, np.cumsum(sizes.astype(np.int64))]
    return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def align(a: Vocabulary, b: Vocabulary, texts: list[str], digits: np.ndarray, keep_text: bool = False) -> dict:
    """All that a chunk of texts gives: figures and digests by text, its pairs of ids, and each text's pairs with how often they are linked."""
    ids: list[list[np.ndarray]] = [[], []]
    start = held = 0
    for i, t in enumerate([*texts, None]):
        if t is None or held and held + len(t) > CALL:
            for of, v in zip(ids, (a, b), strict=True):
                of += v.ids(texts[start:i])
            start, held = i, 0
        held += len(t or "")
    none = np.empty(0, np.int64)
    for i, t in enumerate(texts):
        whole = (" " + t).encode() if t else b""
        if not t or any(v.joined(of[i]).tobytes() != whole for of, v in zip(ids, (a, b), strict=True)):
            ids[0][i] = ids[1][i] = none
    n = [np.array([len(x) for x in of], np.int64) for of in ids]
    flat = [np.concatenate([none, *of]) for of in ids]
    doc = [np.repeat(np.arange(len(texts)), x) for x in n]
    # ends run on through the documents, so they grow over the whole chunk and cuts never span two of them
    end = [np.cumsum(v.length[x]) for v, x in zip((a, b), flat, strict=True)]
    from_a, from_b, at_a, at_b = [], [], 0, 0
    for i, j in zip(*n, strict=True):
        if i:
            p, q = lanes(end[0][at_a : at_a + i], end[1][at_b : at_b + j])
            from_a.append(at_a + p)
            from_b.append(at_b + q)
        at_a, at_b = at_a + i, at_b + j
    first = np.concatenate([none, *from_a])
    link_a, link_b, cuts = lockstep(*end, first, np.concatenate([none, *from_b]), np.r_[first[1:], len(flat[0])] - 1 if len(first) else first)
    ends = np.zeros(len(flat[0]) + 1, np.int64)
    ends[cuts + 1] = 1
    group_a = np.cumsum(ends)[:-1]  # cuts before each token
    shared = np.sort(end[0][cuts])
    group_b = np.searchsorted(shared, end[1], "left")
    groups = np.bincount(doc[0][cuts], minlength=len(texts))
    names = spelled(*flat, group_a, group_b, *doc, len(texts), digits)
    # the chunk's pairs, then those of each text
    at, pairs = pd.factorize(flat[0][link_a] * WIDE + flat[1][link_b])
    of_doc = doc[0][link_a]
    at, both = pd.factorize(of_doc * max(len(pairs), 1) + at)
    turn = np.argsort(both)
    often = np.bincount(at, minlength=len(both))[turn]
    of, pair = np.divmod(both[turn], max(len(pairs), 1))
    out = {
        "n_a": n[0], "n_b": n[1], "n_groups": groups, "n_links": np.bincount(of_doc, minlength=len(texts)), "sha": [hashlib.sha256(t).hexdigest() if t else "" for t in names],
        "pairs": pairs, "kinds": np.bincount(of, minlength=len(texts)), "pair": pair, "often": often,
    }
    return out | ({"groups": [t.decode() for t in names]} if keep_text else {})


CHUNKS = (
    "chunk bigint, digest array<string>, copies array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, "
    "pairs array<bigint>, counts array<bigint>, kinds array<bigint>, linked binary"
)
KINDS = {"array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "binary": pa.binary()}


def _packed(pair: np.ndarray, often: np.ndarray) -> bytes:
    """Places and counts in few bytes: the places ascend within a text, so their steps are small."""
    return pa.compress(np.r_[np.diff(pair, prepend=0), often].astype(np.int32).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int32).astype(np.int64)
    return np.cumsum(both[:n]), both[n:]


def aligned(texts: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of (digest, content, n): CHUNKS, where counts are of links of all n copies.

    ``linked`` has for each text its pairs, as places in ``pairs``, and how often it links them; a chunk's name is a hash of its digests.
    """

    def run(batches):
        a, b = Vocabulary(path_a), Vocabulary(path_b)
        digits = _digits(max(len(a.length), len(b.length)))

        def solve(digest, content, copies):
            out = align(a, b, content, digits)
            counts = np.bincount(out["pair"], out["often"] * np.repeat(np.array(copies), out["kinds"]), minlength=len(out["pairs"]))
            # names only have to differ among the chunks of one result
            name = int.from_bytes(hashlib.sha256("".join(digest).encode()).digest()[:8], "big", signed=True)
            row = out | {"chunk": name, "digest": digest, "copies": copies, "counts": counts.astype(np.int64), "linked": _packed(out["pair"], out["often"])}
            cells = [c.split() for c in CHUNKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], KINDS[kind]) for c, kind in cells], names=[c for c, _ in cells])

        held, size = [[], [], []], 0
        for batch in batches:
            for cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size and size + len(cells[1]) > chunk:
                    yield solve(*held)
                    held, size = [[], [], []], 0
                for of, cell in zip(held, cells, strict=True):
                    of.append(cell)
                size += len(cells[1])
        if held[0]:
            yield solve(*held)

    return texts.select("digest", "content", "n").mapInArrow(run, CHUNKS)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(digest, content, n): one row for each content that is not empty, and how many rows have it.

    The smallest id stands for equal contents, chosen by digests before any text moves.
    """
    rows = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", F.col("text").alias("content")).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    lead = rows.groupBy("digest").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).withColumnRenamed("digest", "lead")
    found = rows.join(lead.hint("shuffle_hash"), (F.col("digest") == F.col("lead")) & F.col("doc_id").eqNullSafe(F.col("leader")))
    return found.select("digest", "doc_id", "content", "n").dropDuplicates(["digest", "doc_id"]).select("digest", "content", "n")


def scored(chunks: DataFrame) -> DataFrame:
    """(digest, copies, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text of written ``chunks``."""
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).withColumn("b", F.col("pair") % WIDE), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    known = counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"), "chunks")
    facts = salted_lookup(pairs.select("chunk", "at", "pair"), known, "pair", "chunks", F.col("chunk"))
    back = facts.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("facts"))
    back = back.select(F.col("chunk").alias("own"), F.col("facts.n").alias("n"), F.col("facts.best").alias("best"))
    both = chunks.join(back, F.col("chunk") == F.col("own"), "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                kinds = row["kinds"].values.to_numpy()
                pair, often = _unpacked(row["linked"].as_py(), int(kinds.sum()))
                n, best = (row[c].values.to_numpy(zero_copy_only=False) if row[c].is_valid else np.empty(0, np.int64) for c in ("n", "best"))
                doc = np.repeat(np.arange(len(kinds)), kinds)
                n_best, total = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
                if len(pair):
                    np.add.at(n_best, doc, often * best[pair])
                    np.add.at(total, doc, often * n[pair].astype(np.int64))
                cells = [*(row[c].values for c in ("digest", "copies", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(total), row["sha"].values]
                yield pa.RecordBatch.from_arrays(cells, names=["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = "digest string, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return both.select("digest", "copies", "n_a", "n_b", "n_groups", "n_links", "sha", "kinds", "linked", "n", "best").mapInArrow(run, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``, which needs doc_id and text."""
    docs = docs.select("doc_id", "text")
    results = written(scored(written(aligned(distinct_texts(docs), path_a, path_b, chunk), "chunks")), "aligned")
    some = F.coalesce(F.col("text") != "", F.lit(False))
    rows = docs.where(some).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    found = salted_lookup(rows, results, "digest", "copies", F.xxhash64("doc_id"))
    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    empty = docs.where(~some).select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in figures], F.lit("").alias("groups_sha256"))
    return found.select("doc_id", *figures, "groups_sha256").unionAll(empty)
