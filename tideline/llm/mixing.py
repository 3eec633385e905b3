"""Mix sources to target sizes by pivotal dependent rounding, with DataFrame functions only.

A document of a source with target T and size S is to appear T / S times: the whole part always, the
fraction as a probability. Rounding works in words. Two documents with fractions p and q pass words
of expected mass (size times fraction) from one to the other, in a random direction whose odds keep
both expectations, until one fraction becomes 0 or 1; the other goes on. The mass of a source never
changes, so its words come out at the target but for one last fraction.

The reduction is a tree: documents are dealt by a hash to groups of about ``FAN``, as many as the
source needs, so a hot source is simply more groups; each group leaves one residual, and residuals
are combined ``FAN`` at a time. About ``RESERVE`` documents of each source, chosen by a hash, enter
only the last group of their source. There, as in every group, large documents come first, so that
the last residual is among the small ones. It is rounded to the nearer whole number, and documents of
that last group are turned over to make up for the words of this rounding.

Randomness is a hash of the seed and the two documents: reruns agree. Defined results: a null text
has no words; documents without words are never taken; a null source is a source of its own, last in
order; rows that repeat an id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, tasks, uniform
from tideline.session import written

FAN = 64
RESERVE = 512


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``rank`` from 0, by code point with null last, without gathering all sources in one task."""
    n = tasks(sources.sparkSession)
    dealt = written(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "sources")
    from pyspark.sql import Window as W

    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))  # one row per task
    before = counts.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("own", own).join(before, "__part").withColumn("rank", F.col("own") + F.col("before")).drop("__part", "own", "before")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, target): ``share`` of all sizes by weight, at most ``most`` times a source's size.

    The weights repeat along the ranked sources. What a source cannot take goes to the others by
    weight until none is above its limit. Every round is one aggregate row; each round but the last
    fills at least one more source.
    """
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(sources.select("source", "source_size", "n", weight.cast("double").alias("weight")), "weights")
    limit, rate, full = F.col("source_size") * F.lit(most), 0.0, -1
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    while True:
        is_full = limit <= F.col("weight") * F.lit(rate)
        row = sources.agg(F.count(F.when(is_full, 1)).alias("full"), F.coalesce(F.sum(F.when(is_full, limit)), F.lit(0.0)).alias("taken"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        if row["full"] == full or not row["open"]:
            break
        full, rate = row["full"], (total - row["taken"]) / row["open"]
    return sources.select("source", "source_size", "n", F.least(limit, F.col("weight") * F.lit(rate)).alias("target"))


def _let(value: Column, use) -> Column:
    """``use`` applied to ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _unit(u: Column, p: Column) -> Column:
    return F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), p.alias("p"))


def _decided(u: Column, copies: int) -> Column:
    return F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), F.lit(copies).alias("copies"))


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One step of the pivotal method between the held unit and ``x``."""

    def step(v: Column) -> Column:
        h = v["held"]
        up_x, up_h = F.least(v["a"], v["room_x"]), F.least(v["b"], v["room_h"])
        to_x = F.coalesce(uniform(F.lit(seed), h["doc_id"], h["size"], h["p"], x["doc_id"], x["size"], x["p"]) < up_h / (up_x + up_h), F.lit(False))
        out = lambda held, p, done, copies: F.struct(_unit(held, p).alias("held"), F.concat(v["done"], F.array(_decided(done, copies))).alias("done"))
        return (
            F.when(v["held"].isNull(), F.struct(_unit(x, x["p"]).alias("held"), v["done"].alias("done")))
            .when(to_x & (v["a"] <= v["room_x"]), out(x, (v["b"] + v["a"]) / x["size"], h, 0))
            .when(to_x, out(h, (v["a"] - v["room_x"]) / h["size"], x, 1))
            .when(v["b"] <= v["room_h"], out(h, (v["a"] + v["b"]) / h["size"], x, 0))
            .otherwise(out(x, (v["b"] - v["room_h"]) / x["size"], h, 1))
        )

    h = acc["held"]
    masses = F.struct(
        h.alias("held"), acc["done"].alias("done"),
        (h["size"] * h["p"]).alias("a"), (h["size"] * (1 - h["p"])).alias("room_h"),
        (x["size"] * x["p"]).alias("b"), (x["size"] * (1 - x["p"])).alias("room_x"),
    )
    return _let(masses, step)


def _folded(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """One row per group: ``held``, its residual, and ``done``, the documents decided."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("first"), "doc_id", "size", "p")))
    start = F.struct(F.lit(None).cast("struct<size:bigint,doc_id:bigint,p:double>").alias("held"), F.array().cast("array<struct<size:bigint,doc_id:bigint,copies:int>>").alias("done"))
    return units.groupBy(*keys).agg(order.alias("units")).select(*keys, F.aggregate("units", start, lambda acc, x: _pair(acc, x, seed)).alias("r")).select(*keys, "r.held", "r.done")


def _settled() -> Column:
    """All documents of a last group: its residual is rounded to the nearer number, and the words this adds
    or takes away are made up for by turning over decided documents, large ones first, that fit."""
    up = F.col("held.p") >= 0.5
    own = F.struct(F.col("held.size").alias("size"), F.col("held.doc_id").alias("doc_id"), F.when(up, 1).otherwise(0).alias("copies"))
    missing = F.col("held.size") * (F.col("held.p") - F.when(up, 1.0).otherwise(0.0))

    def turn(acc: Column, x: Column) -> Column:
        more = (x["copies"] == 0) & (x["size"] <= acc["missing"])
        less = (x["copies"] == 1) & (x["size"] <= -acc["missing"])
        new = F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), F.when(more, 1).when(less, 0).otherwise(x["copies"]).alias("copies"))
        return F.struct((acc["missing"] - F.when(more, x["size"]).when(less, -x["size"]).otherwise(0)).alias("missing"), F.concat(acc["out"], F.array(new)).alias("out"))

    start = F.struct(missing.cast("double").alias("missing"), F.array(own).alias("out"))
    return F.aggregate(F.reverse(F.array_sort("done")), start, turn)["out"]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of ``docs``, which needs doc_id, source and text."""
    sized = written(sizes(docs.select(F.col("doc_id").cast("bigint"), "source", "text")), "sizes")
    goal = written(targets(sized, weights, share, most), "targets")
    of = goal.select(F.col("source").alias("__source"), "source_size", "target", "n", (F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).alias("rate"))
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("__source"))).withColumns({"base": F.coalesce(F.floor("rate"), F.lit(0)).cast("int"), "p": F.coalesce(F.col("rate") - F.floor("rate"), F.lit(0.0))})
    fraction = (F.col("size") > 0) & (F.col("p") > 0)
    groups = F.ceil(F.col("n") / FAN)
    bucket = F.when(uniform(F.lit(seed), F.lit("reserve"), "doc_id", "size") * F.col("n") < RESERVE, -1).otherwise(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), groups))
    units = rows.where(fraction).select("source", "doc_id", "size", "p", bucket.cast("bigint").alias("bucket"))
    reserve = units.where("bucket < 0").select("source", "size", "doc_id", "p")
    decided = []
    level = written(_folded(units.where("bucket >= 0"), ["source", "bucket"], seed), "mix")
    while True:
        decided.append(level.select("source", F.explode("done").alias("d")))
        left = level.select("source", "bucket", "held.*")
        if (left.agg(F.max("bucket")).first()[0] or 0) == 0:
            break
        level = written(_folded(left.withColumn("bucket", F.floor(F.col("bucket") / FAN)), ["source", "bucket"], seed), "mix")
    last = written(_folded(left.select("source", "size", "doc_id", "p").unionByName(reserve), ["source"], seed).select("source", _settled().alias("done")), "mix")
    decided.append(last.select("source", F.explode("done").alias("d")))
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionAll(d)
    parts = extra.select("source", "d.doc_id", "d.size", "d.copies").unionByName(rows.where(~fraction).select("source", "doc_id", "size", F.lit(0).alias("copies")))
    out = parts.join(of, F.col("source").eqNullSafe(F.col("__source")))
    whole = F.when(F.col("size") > 0, F.coalesce(F.floor("rate"), F.lit(0)) + F.col("copies")).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", whole.cast("int").alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``copies``, which replaces a column of that name.

    Rows that repeat an id, source and size all get the most copies drawn among them.
    """
    drawn = mix(docs, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    drawn = drawn.select(*[F.col(c).alias(f"__{c}") for c in drawn.columns]).hint("shuffle_hash")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col("__doc_id")) & docs["source"].eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    return docs.join(drawn, same).select(*[docs[c] for c in docs.columns if c.lower() != "copies"], F.col("__copies").alias("copies"))
