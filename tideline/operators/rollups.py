"""Hourly rollups of posts and news, text polarity, sentiment mixes and plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.nulls import clamp, ratio
from tideline.functions.rolling import series_window


def _half(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.5))


def post_rollup(posts: DataFrame, hour: Column | None = None) -> DataFrame:
    """Hourly mood and engagement of posts; polarity scaled to [0, 1], unknown is 0.5.

    ``hour`` defaults to the floor of ``ts``; a stream passes its event-time window.
    """
    return posts.groupBy((hour if hour is not None else F.date_trunc("hour", "ts")).alias("ts")).agg(
        _half((F.avg("polarity") + 1) / 2).alias("sentiment_score"),
        _half(F.stddev_samp("polarity")).alias("sentiment_volatility"),
        F.count("polarity").alias("post_count"),
        _half(F.avg("subjectivity")).alias("subjectivity"),
        _half(F.avg("score")).alias("avg_score"),
        _half(F.sum("score")).alias("total_score"),
        _half(F.avg("comments")).alias("avg_comments"),
        _half(F.sum("comments")).alias("total_comments"),
        _half(F.avg("upvote_ratio")).alias("avg_upvote_ratio"),
    )


def news_rollup(news: DataFrame, hour: Column | None = None) -> DataFrame:
    return news.groupBy((hour if hour is not None else F.date_trunc("hour", "ts")).alias("ts")).agg(
        _half((F.avg("polarity") + 1) / 2).alias("news_sentiment"),
        _half(F.stddev_samp("polarity")).alias("news_sentiment_volatility"),
        F.count("polarity").alias("news_article_count"),
        _half(F.avg("subjectivity")).alias("news_subjectivity"),
    )


def sentiment_combine(d: DataFrame, sources: Sequence[str] = ("reddit", "news", "fear_greed")) -> DataFrame:
    """One sentiment figure from up to three aligned sources, with volumes and ratios.

    Expects ``reddit_sentiment, reddit_volume, reddit_engagement``, ``news_sentiment,
    news_volume`` and ``fear_greed_sentiment, fear_greed_index`` of the sources in use;
    a missing value is 0.5 for moods, 50 for the index and 0 for volumes.
    """
    has = set(sources)
    weights = {"reddit": 0.3, "news": 0.3, "fear_greed": 0.4} if len(has) == 3 else {s: 1 / len(has) for s in has}
    mood = {s: _half(F.col(f"{s}_sentiment")) for s in sources}
    score = sum(F.lit(weights[s]) * mood[s] for s in sources) if has else F.lit(0.5)
    zero = F.lit(0.0)
    posts = F.coalesce(F.col("reddit_volume"), zero) if "reddit" in has else zero
    news = F.coalesce(F.col("news_volume"), zero) if "news" in has else zero
    engagement = F.coalesce(F.col("reddit_engagement"), zero) if "reddit" in has else zero
    index = F.coalesce(F.col("fear_greed_index"), F.lit(50.0)) if "fear_greed" in has else F.lit(50.0)
    d = d.withColumns({"sentiment_score": score, "__posts": posts, "__news": news})
    d = d.withColumn("bullish_ratio", clamp(F.col("sentiment_score") * 1.2 - 0.1, 0, 1))
    return d.withColumns(
        {
            "tweet_volume": F.greatest(F.col("__posts") + F.col("__news") * 10, F.lit(100.0)).cast("bigint"),
            "reddit_posts": F.col("__posts").cast("bigint"),
            "news_articles": F.col("__news").cast("bigint"),
            "fear_greed_index": index.cast("bigint"),
            "bearish_ratio": 1 - F.col("bullish_ratio"),
            "social_dominance": clamp((F.col("__posts") + F.col("__news")) / 1000, 0, 1),
            "engagement_rate": clamp(engagement / F.greatest(F.col("__posts"), F.lit(1.0)) / 50, 0, 1),
        }
    ).drop("__posts", "__news")


def fear_greed_scale(d: DataFrame, index: str = "fear_greed_index") -> DataFrame:
    return d.withColumn("fear_greed_normalized", F.col(index) / 100.0)


# A small word list for text polarity, positive and negative words.
POSITIVE = ["gain", "good", "great", "growth", "high", "profit", "rise", "strong", "up", "win"]
NEGATIVE = ["bad", "crash", "drop", "fall", "fear", "loss", "low", "risk", "down", "weak"]


def lexicon_polarity(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of the lexicon words of a text and the share of its words they make.

    ``lexicon`` is ``(word, polarity)``, one row per word; Spark broadcasts it if it is small. The words of
    a text are summed up where they are read, so that one row per text is shuffled.
    """
    words = texts.select(key, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.join(lexicon, "word", "left").groupBy(key).agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
        ratio(F.count("polarity").cast("double"), F.count("*").cast("double")).alias("subjectivity"),
        F.count("*").alias("n_words"),
    )


def lexicon_table(spark, positive=POSITIVE, negative=NEGATIVE) -> DataFrame:
    rows = [F.struct(F.lit(w).alias("word"), F.lit(p).alias("polarity")) for ws, p in ((positive, 1.0), (negative, -1.0)) for w in ws]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.word", "r.polarity")


def gradient(df: DataFrame, column: str, name: str, keys: Sequence[str] = ("series_key",)) -> DataFrame:
    """Central difference, one-sided at both ends."""
    w = series_window(keys)
    before, after, x = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    g = F.when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)
    return df.withColumn(name, g)
