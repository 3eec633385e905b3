"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def bounded_sample(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` different rows of each label, chosen by a hash of the other columns, with ``label`` for the label's name.

    A threshold on the hash first brings each label down to about the bound, so that no label's
    rows are gathered; the exact bound is then applied to what is left.
    """
    from pyspark.sql import Window as W

    keys = [c for c in labelled.columns if c != label]
    rows = labelled.select(*keys, F.col(label).alias("label")).distinct().withColumn("u", uniform(F.lit(7), *keys))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))  # one row a label
    near = rows.join(F.broadcast(counts), "label").where(F.col("u") * F.col("n") <= 1.1 * per_label + 50)
    order = F.row_number().over(W.partitionBy("label").orderBy("u", *keys))
    return near.withColumn("at", order).where(F.col("at") <= per_label).select(*keys, "label")


#: Rows of one key from which a lookup deals them out, and over how many parts.
HEAVY, SALTS = 1000, 64


def salted_lookup(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of the row of ``facts`` that has their ``key``; rows without one go.

    ``facts`` has one row for each key, and ``count`` tells how many rows have it. Keys of more than HEAVY
    rows are copied to SALTS parts, among which ``spread`` deals the rows, so no task gets all rows of a
    key. They are at most one in HEAVY rows, so the copies are fewer than the rows themselves.
    """
    own = rows.columns
    found = F.struct(*[c for c in facts.columns if c != key])
    many = facts.where(F.col(count) > HEAVY).select(F.col(key).alias("__many_key"), found.alias("__many"), F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias("__part"))
    # the zero comes from a column, so that it stays a part of the join's key
    few = facts.where(F.col(count) <= HEAVY).select(F.col(key).alias("__few_key"), found.alias("__few"), F.pmod(F.col(count), F.lit(1)).cast("int").alias("__zero"))
    dealt = rows.withColumn("__salt", (F.pmod(spread, F.lit(SALTS)) + 1).cast("int"))
    dealt = dealt.join(many, (F.col(key) == F.col("__many_key")) & (F.col("__salt") == F.col("__part")), "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__many").isNull(), 0).otherwise(F.col("__salt")))
    both = dealt.join(few, (F.col(key) == F.col("__few_key")) & (F.col("__salt") == F.col("__zero")), "left").withColumn("__fact", F.coalesce("__many", "__few"))
    return both.where("__fact IS NOT NULL").select(*own, "__fact.*")
