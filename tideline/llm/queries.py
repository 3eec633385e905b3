"""One query per operator, each with production parameters over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import alignment, bm25, chat, covertree, crosspolytope, langid, latent, line_templates, mixing, simhash, token_cache, toxicity, warc
from tideline.llm.common import held_out, table
from tideline.session import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("op1_warc_revisits", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f""")
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as deduplicated archives, read the archives back and follow the revisits."""
    path = warc.write_archives(table(spark, sf_dir, "pages"), _new(spark, "warc"))
    return warc.follow_revisits(warc.read_archives(spark, path, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents through a cache that starts empty."""
    import public_tokenizers

    counts = token_cache.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), _new(spark, "tokens"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: weights 5, 2, 1, 150 % of all words, at most twice each source."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]*"


@query("op5_line_templates", f"""
WITH RECURSIVE l AS (
  SELECT doc_id, pos, string_split(text, chr(10))[pos] AS raw FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(pos)),
m AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_replace(raw, '{NOT_SPACE}[0-9]{NOT_SPACE}', '<*>', 'g') ELSE raw END, '{SPACE}', ' ', 'g')) AS masked FROM l),
t AS (SELECT doc_id, pos, masked, string_split(masked, ' ') AS tokens FROM m WHERE masked <> ''),
v AS (SELECT *, CAST(len(tokens) AS VARCHAR) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM t),
cand AS (SELECT leaf FROM v GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
w AS (SELECT leaf, masked, any_value(tokens)[4:] AS rest, CAST(count(*) AS BIGINT) AS n FROM v SEMI JOIN cand USING (leaf) GROUP BY leaf, masked),
r AS (
  SELECT leaf AS grp, leaf, masked, rest, n, false AS same FROM w
  UNION ALL SELECT * FROM (
    WITH s AS (SELECT grp, sum(n) AS total FROM r WHERE NOT same GROUP BY grp HAVING count(*) > 1 AND sum(n) >= 5),
    o AS (SELECT r.*, total FROM r JOIN s USING (grp) WHERE NOT same),
    x AS (SELECT grp, leaf, masked, n, total, unnest(rest) AS token, generate_subscripts(rest, 1) AS i FROM o),
    c AS (SELECT *, sum(n) OVER (PARTITION BY grp, i, token) AS c FROM x),
    j AS (SELECT grp, leaf, masked, count(*) FILTER (2 * c > total) AS hits, max(struct_pack(c := c, back := -i, token := token)) FILTER (2 * c <= total AND c >= 5) AS top FROM c GROUP BY grp, leaf, masked),
    k AS (SELECT o.*, 2 * hits >= len(o.rest) AS fits, top FROM o JOIN j USING (grp, leaf, masked))
    SELECT CASE WHEN fits THEN grp ELSE grp || ' | ' || CAST(-top.back AS VARCHAR) || ' ' || top.token END, leaf, masked, rest, n, fits FROM k WHERE fits OR top IS NOT NULL)),
named AS (SELECT w.leaf, w.masked, CASE WHEN r.grp IS NOT NULL THEN '* ' || r.grp ELSE '= ' || w.masked END AS template FROM w LEFT JOIN (SELECT * FROM r WHERE same) r USING (leaf, masked)),
often AS (SELECT template, min(doc_id) AS first FROM v JOIN named USING (leaf, masked) GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
lost AS (SELECT doc_id, pos FROM v JOIN named USING (leaf, masked) JOIN often USING (template) WHERE doc_id <> first),
kept AS (SELECT l.doc_id, string_agg(raw, chr(10) ORDER BY l.pos) FILTER (lost.pos IS NULL) AS text, count(*) AS n_lines, count(lost.pos) AS n_dropped FROM l LEFT JOIN lost USING (doc_id, pos) GROUP BY l.doc_id)
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped FROM kept""")
def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose template recurs in five documents or more."""
    out = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "n_lines", "n_dropped")


MARKS = "<|im_end|><|im_start|>assistant ok"


@query("op6_chat_format", f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKS}' UNION ALL SELECT -1, 1, 'assistant', '{MARKS}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as trees, their best branch formatted, written and read back."""
    extra = spark.range(-1, 0).select(F.col("id").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select("conv_id", "t.*", F.lit(MARKS).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = written(chat.format_branches(chat.branches(chat.as_tree(turns))), "chat")
    back = out.select(F.col("root.conv_id").alias("conv_id"), F.col("formatted"), chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("t").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_latent_decontamination")
def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    docs = table(spark, sf_dir, "documents")
    return latent.matches(docs, latent.prepare(docs, table(spark, sf_dir, "benchmark")))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles of all documents, linked within 3 bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_bm25_top10")
def op10_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.col("doc_id") % 50 == 0))


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of all vectors whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op13_vector_near_dedup", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding) AND len(list_filter(embedding, lambda c: c <> 0)) > 0, false) AS usable
  FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE a.usable AND b.usable AND list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.95),
c AS (SELECT r, r AS reached FROM v UNION SELECT c.r, l.b FROM c JOIN l ON c.reached = l.a),
g AS (SELECT c.r, min(v.vec_id) AS component_id FROM c JOIN v ON c.reached = v.r GROUP BY c.r),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN g USING (r) LEFT JOIN n USING (r)""")
def op13_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.95 or more."""
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers, linked and grouped by the bytes they stand for."""
    import public_tokenizers

    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
