"""Line deduplication by a template tree of fixed depth, with DataFrame functions only.

A line's tokens are parsed down a tree: by the number of tokens, then by the leading ``DEPTH`` tokens.
Tokens with a digit are variable fields and become ``<*>`` first. Of the lines in a leaf, positions where one
token prevails (over half of the lines) are constant, the others are variable fields as well. A line
belongs to that template if it has the constant token at ``SIMILAR`` of its positions after the leading
ones at least. The leaf's other lines part into groups by the token, at a position of its own, that most of
the leaf's lines have, and each group is treated as the leaf was, until every line belongs to a template
or stands in a group of fewer than ``least`` lines. So a leaf has any number of templates, whatever
else shares it. Lines without such a template are templates of their own. Templates that recur in ``least``
documents or more are dropped from all but the document with the smallest id, which keeps its lines.

``drop_passages`` is for lines long enough that no two documents have them by chance: a masked line of over
``tokens`` tokens is dropped word for word from two documents on. The pipeline runs it once near
copies are gone; before, it would leave rests of copies that are no longer near any document.

Digests of lines are shuffled, not texts; equal lines are counted before the shuffle, so a hot line
or leaf is a few rows. Only leaves with ``least`` documents get their lines' tokens looked at; tokens
that a whole leaf shares are looked up in salted parts. Texts
move once, to meet the places of their dropped lines; documents that lose nothing meet none.

Defined results: lines end at LF; a null text stays null, an empty one empty; blank lines are never
dropped; a document that loses all its lines has an empty text and stays; rows sharing a doc_id are
one document; a null doc_id comes last, so such a row never is the one that keeps a template unless
all are null; an empty table stays empty; all columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import salted_lookup
from tideline.session import written, written_alone

DEPTH = 3
SIMILAR = 0.5
SPACE = r"[\x20\x09-\x0D]+"
VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def tokens_of(masked: Column) -> Column:
    return F.split(masked, " ")


def lines_of(docs: DataFrame, over: int = 0) -> DataFrame:
    """(doc_id, row, at, masked, leaf, line): the lines with a token, ``row`` telling a doc_id's texts apart.

    ``masked`` has variable fields for tokens with digits and single spaces; ``leaf`` is a hash of the
    leaf (should two meet, their lines are compared, no more), ``line`` the MD5 digest of the masked line.
    Only lines of more than ``over`` tokens.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    if over:
        rows = rows.where(F.length("raw") > 2 * over)  # so many tokens and the spaces between them
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", VARIABLE, "<*>")).otherwise(F.col("raw"))
    spaced = F.trim(F.regexp_replace(masked, SPACE, " "))
    rows = rows.select("doc_id", "row", "at", spaced.alias("masked")).where("masked <> ''")
    gaps = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    if over:
        rows = rows.where(gaps >= over)
    leaf = F.concat_ws(" ", gaps.cast("string"), F.substring_index("masked", " ", DEPTH))
    return rows.withColumns({"leaf": F.xxhash64(leaf), "line": F.unhex(F.md5("masked"))})


def _places(masked: Column) -> Column:
    """Hashes of the tokens after the leading ones, each with its position."""
    tokens = tokens_of(masked)
    rest = F.slice(tokens, DEPTH + 1, F.greatest(F.size(tokens) - DEPTH, F.lit(0)))
    return F.transform(rest, lambda token, at: F.xxhash64(at, token))


def _grown(variants: DataFrame, least: int) -> DataFrame:
    """(line, template) of the ``variants`` (leaf, line, masked, n) that belong to a template with variable fields.

    Each round works on all groups at once; a group's lines share one more token in each, which is then
    constant, so a line is settled after half as many rounds as it has positions at the latest.
    """
    found, state, level = None, variants.withColumnRenamed("leaf", "grp"), 0
    while True:
        sizes = state.groupBy("grp").agg(F.count("*").alias("k"), F.sum("n").alias("all"))
        live = state.join(sizes.where((F.col("k") > 1) & (F.col("all") >= least)).drop("k"), "grp")
        at = live.select("grp", "all", "n", F.explode(_places(F.col("masked"))).alias("place"))
        counts = at.groupBy("grp", "place").agg(F.sum("n").alias("c"), F.count("*").alias("k"), F.max("all").alias("all"))
        counts = written(counts.where((F.col("c") >= least) | (2 * F.col("c") > F.col("all"))), "counts")
        constants = counts.where(2 * F.col("c") > F.col("all")).groupBy("grp").agg(F.collect_list("place").alias("constants"))  # of one line's length
        places = _places(F.col("masked"))
        agree = F.coalesce(F.size(F.array_intersect(places, "constants")), F.lit(0))
        judged = live.join(constants, "grp", "left").select("grp", "line", "masked", "n", (agree >= SIMILAR * F.size(places)).alias("same"))
        judged = written(judged, "judged")
        settled = judged.where("same").select("line", F.concat(F.lit(f"{level} "), F.col("grp").cast("string")).alias("template"))
        found = settled if found is None else found.unionAll(settled)
        rest = judged.where("NOT same")
        own = rest.select("line", F.col("grp").alias("of"), F.posexplode(_places(F.col("masked"))).alias("at", "place"))
        own = own.select("line", "at", F.xxhash64("of", "place").alias("grp"))
        facts = counts.where((2 * F.col("c") <= F.col("all")) & (F.col("c") >= least)).select(F.xxhash64("grp", "place").alias("grp"), "c", "k")
        strongest = salted_lookup(own, facts, "grp", "k", F.xxhash64("line")).groupBy("line").agg(F.max(F.struct("c", (-F.col("at")).alias("back"), "grp")).alias("top"))
        state = written(rest.select("line", "masked", "n").join(strongest.select("line", "top.grp"), "line"), "open")
        if not state.limit(1).count():
            return found
        level += 1


def templates(lines: DataFrame, least: int) -> DataFrame:
    """(line, template, docs, first): of the masked lines whose template recurs in ``least`` documents.

    ``lines`` is the written table of ``lines_of``. ``first`` is the smallest doc_id.
    """
    leaves = lines.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    leaves = written(leaves.select("leaf"), "leaves")  # as a table its size is known, and Spark broadcasts it only if small
    variants = written(lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "line", "masked").agg(F.count("*").alias("n")), "variants")
    grown = _grown(variants, least).select(F.col("line").alias("grown"), "template")
    template = F.coalesce("template", F.hex("line"))
    named = written(variants.join(grown, F.col("line") == F.col("grown"), "left").select("line", template.alias("template")), "templates")
    seen = lines.select("line", "doc_id").distinct().join(named, "line").select("template", "doc_id").distinct()
    often = seen.groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= least)
    return named.join(often, "template").select("line", "template", "docs", "first")


def _lost(lines: DataFrame, often: DataFrame) -> DataFrame:
    """(doc_id, row, lost): places of the ``lines`` that are in ``often`` (line, first), but for the first document's."""
    lost = lines.select("doc_id", "row", "at", "line").join(often, "line").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "row").agg(F.collect_set("at").alias("lost"))  # of one document


def _without(docs: DataFrame, lost: DataFrame, counts: bool) -> DataFrame:
    """``docs`` without the lines of ``_lost``; with ``counts`` n_lines and n_dropped."""
    kept = docs.join(lost.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(lost["doc_id"]) & (F.xxhash64(docs["text"]) == lost["row"]), "left")
    parts = F.split(docs["text"], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost["lost"])
    text = F.when(lost["lost"].isNull(), docs["text"]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    own = {"n_lines": F.size(parts), "n_dropped": F.size(lost["lost"])} if counts else {}
    return kept.select(
        *[text.alias(c) if c == "text" else docs[c] for c in docs.columns if c.lower() not in own],
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(c) for c, n in own.items()],
    )


def drop_recurring(docs: DataFrame, least: int = 5, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``text`` lacking recurring lines.

    With ``counts`` also n_lines and n_dropped, which replace columns of these names.
    """

    def lost() -> DataFrame:
        lines = written(lines_of(docs.select("doc_id", "text")), "lines")
        return _lost(lines, templates(lines, least).select("line", "first"))

    return _without(docs, written_alone(docs.sparkSession, lost, "lost"), counts)


def drop_passages(docs: DataFrame, tokens: int = 50, counts: bool = True) -> DataFrame:
    """As ``drop_recurring``, of the lines with over ``tokens`` tokens that two documents have, variable fields masked."""

    def lost() -> DataFrame:
        lines = written(lines_of(docs.select("doc_id", "text"), tokens).select("doc_id", "row", "at", "line"), "passages")
        seen = lines.select("line", "doc_id").distinct().groupBy("line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
        return _lost(lines, seen.where("docs > 1").select("line", "first"))

    return _without(docs, written_alone(docs.sparkSession, lost, "lost"), counts)
