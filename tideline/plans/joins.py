"""Queries: time alignment, timeframe and parameter joins, rollups, plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import joins as jn
from tideline.operators import rollups as ro
from tideline.operators import quality as qu
from tideline.operators import selection as sel
from tideline.operators.bars import CADENCE_SECONDS, resample_bars
from tideline.operators.ordered import Slices
from tideline.plans.inputs import (
    TICKS, BARS_D, BARS_H, EVENT_TICKS, ORDER_DAYS, POSTS, bars_d, bars_h, epoch, event_ticks, order_days, posts, table,
)
from tideline.plans.registry import query
from tideline.session import written

W = "PARTITION BY series_key ORDER BY ts"
TS = "epoch(ts)::BIGINT AS ts"
HOUR = 3600

for _every, _unit in (("1min", "minute"), ("5min", "5 minutes"), ("15min", "15 minutes"), ("1h", "hour"), ("4h", "4 hours"), ("1D", "day"), ("1W", "7 days")):
    _origin = ", TIMESTAMP '1970-01-05'" if _every == "1W" else ", TIMESTAMP '1970-01-01'"

    @query(f"resample_{_every.lower()}", f"""WITH {EVENT_TICKS} SELECT series_key,
  epoch(time_bucket(INTERVAL '{_unit if _unit[0].isdigit() else '1 ' + _unit}', ts{_origin}))::BIGINT AS ts,
  arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(qty) AS volume
FROM event_ticks GROUP BY 1, 2""", "open high low close volume")
    def resample(spark, d, every=_every):
        return epoch(resample_bars(event_ticks(spark, d), every))


@query("resample_bars", f"WITH {BARS_D} SELECT series_key, {TS}, open, high, low, close, volume FROM bars", "open high low close volume")
def resample_daily(spark, d):
    return epoch(bars_d(spark, d))


# --- as-of ------------------------------------------------------------------------------

def _weekly(spark, d):
    """Orders by week, known at its end: a slow source without series."""
    end = F.timestamp_seconds((F.floor(F.unix_timestamp("ts") / 604800) + 1) * 604800)
    days = order_days(spark, d).withColumn("week", end)
    return days.groupBy(F.col("week").alias("ts")).agg(F.avg("avg_price").alias("avg_price"), F.sum("n_orders").alias("n_orders"), F.sum("filled").alias("filled"))


_WEEKLY = """weekly AS (SELECT make_timestamp((epoch(ts)::BIGINT // 604800 + 1) * 604800 * 1000000) AS ts, avg(avg_price) AS avg_price, sum(n_orders)::BIGINT AS n_orders,
  sum(filled) AS filled FROM order_days GROUP BY 1)"""


@query("asof_join", f"""WITH {BARS_D}, {ORDER_DAYS}, {_WEEKLY}
SELECT b.series_key, epoch(b.ts)::BIGINT AS ts, b.close, w.avg_price, w.n_orders, w.filled
FROM bars b ASOF LEFT JOIN weekly w ON b.ts >= w.ts""", "close avg_price filled", digits=4)
def asof_join(spark, d):
    left = bars_d(spark, d).select("series_key", "ts", "close")
    return epoch(jn.asof_join(left, _weekly(spark, d), bucket=Slices(30 * 86400)))


@query("asof_join_keyed", f"""WITH {EVENT_TICKS},
r AS (SELECT series_key, ts + INTERVAL 90 SECOND AS ts, seq, price AS mark FROM event_ticks)
SELECT l.series_key, l.seq, l.price, r.mark FROM event_ticks l ASOF LEFT JOIN r ON l.series_key = r.series_key AND l.ts >= r.ts""",
       "price mark")
def asof_join_keyed(spark, d):
    """Ticks of hot series against all ticks of the same series as marks that come 90 seconds late, in slices of bounded rows."""
    t = event_ticks(spark, d)
    left = t.select("series_key", "ts", F.col("seq").alias("id"), "price")
    right = t.select("series_key", (F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("ts"), "seq", F.col("price").alias("mark"))
    return jn.asof_join(left, right, bucket=Slices(HOUR, TICKS)).select("series_key", F.col("id").alias("seq"), "price", "mark")


@query("align_sources", f"""WITH {BARS_D}, {ORDER_DAYS}, {_WEEKLY},
own AS (SELECT series_key, ts, volume AS big_volume FROM bars WHERE volume > 40)
SELECT b.series_key, epoch(b.ts)::BIGINT AS ts, b.close, o.big_volume, w.avg_price, w.n_orders, w.filled, m.n_orders AS n_orders_monthly
FROM bars b ASOF LEFT JOIN own o ON b.series_key = o.series_key AND b.ts >= o.ts
ASOF LEFT JOIN weekly w ON b.ts >= w.ts
ASOF LEFT JOIN (SELECT date_trunc('month', ts) + INTERVAL 1 MONTH AS ts, sum(n_orders)::BIGINT AS n_orders FROM order_days GROUP BY 1) m ON b.ts >= m.ts""",
       "close big_volume avg_price filled", digits=4)
def align_sources(spark, d):
    bars = bars_d(spark, d)
    own = bars.where("volume > 40").select("series_key", "ts", F.col("volume").alias("big_volume"))
    month = F.date_trunc("month", "ts") + F.expr("INTERVAL 1 MONTH")
    monthly = order_days(spark, d).groupBy(month.alias("ts")).agg(F.sum("n_orders").alias("n_orders"))
    out = jn.align_sources(bars.select("series_key", "ts", "close"), {"own": own, "weekly": _weekly(spark, d), "monthly": monthly})
    return epoch(out)


@query("hour_spine", f"""WITH {EVENT_TICKS}, b AS (
  SELECT series_key, date_trunc('hour', min(ts)) AS s, date_trunc('hour', max(ts)) AS e FROM event_ticks GROUP BY 1)
SELECT series_key, epoch(u)::BIGINT AS ts FROM (SELECT series_key, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS u FROM b)""")
def hour_spine(spark, d):
    b = event_ticks(spark, d).groupBy("series_key").agg(
        F.date_trunc("hour", F.min("ts")).alias("start"), F.date_trunc("hour", F.max("ts")).alias("end")
    )
    return epoch(jn.time_spine(b, "1 HOUR"))


_TF = ", ".join(f"h.{c} AS {c}_1h, f.{c} AS {c}_4h" for c in ("open", "close", "volume"))


@query("timeframe_join", f"""WITH {BARS_H}, f AS (
  SELECT series_key, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, seq) AS open,
    arg_max(price, seq) AS close, sum(qty) AS volume FROM event_ticks GROUP BY 1, 2)
SELECT h.series_key, epoch(h.ts)::BIGINT AS ts, {_TF} FROM bars_h h JOIN f USING (series_key, ts)""",
       "open_1h open_4h close_1h close_4h volume_1h volume_4h")
def timeframe_join(spark, d):
    t = event_ticks(spark, d)
    cols = ["series_key", "ts", "open", "close", "volume"]
    return epoch(jn.timeframe_join({"1h": resample_bars(t, "1h").select(cols), "4h": resample_bars(t, "4h").select(cols)}))


@query("positional_zip", f"""WITH {BARS_H}, f AS (
  SELECT series_key, time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01') AS ts, arg_max(price, seq) AS close FROM event_ticks GROUP BY 1, 2),
a AS (SELECT series_key, close, row_number() OVER ({W}) AS pos FROM bars_h), b AS (SELECT series_key, close, row_number() OVER ({W}) AS pos FROM f)
SELECT series_key, pos, a.close AS close_fast, b.close AS close_slow FROM a JOIN b USING (series_key, pos)""", "close_fast close_slow")
def positional_zip(spark, d):
    t = event_ticks(spark, d)
    z = jn.positional_zip({"fast": resample_bars(t, "1h"), "slow": resample_bars(t, "4h")})
    return z.select("series_key", F.col("pos").cast("bigint").alias("pos"), "close_fast", "close_slow")


@query("membership_mask", f"""WITH {BARS_D}, o AS (SELECT DISTINCT series_key, ts FROM bars WHERE volume > 60)
SELECT b.series_key, epoch(b.ts)::BIGINT AS ts, CASE WHEN o.ts IS NULL THEN 0 ELSE 1 END AS is_outlier
FROM bars b LEFT JOIN o ON b.series_key = o.series_key AND b.ts = o.ts""")
def membership_mask(spark, d):
    b = bars_d(spark, d).select("series_key", "ts", "volume")
    return epoch(jn.membership_mask(b, b.where("volume > 60"), ["series_key", "ts"], "is_outlier")).drop("volume")


@query("param_cross", """SELECT n_nationkey, conf, fee FROM nation,
  (VALUES (0.001), (0.002), (0.005)) AS c(conf), (VALUES (0.0), (0.001)) AS f(fee)""", "conf fee")
def param_cross(spark, d):
    """Parameter lists exploded on every row of a table."""
    n = table(spark, d, "nation").select("n_nationkey")
    for name, values in {"conf": [0.001, 0.002, 0.005], "fee": [0.0, 0.001]}.items():
        n = n.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return n


@query("timeframe_lookup", f"""WITH {EVENT_TICKS}, tf(name, seconds) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in CADENCE_SECONDS.items())})
SELECT c.name AS child, p.name AS parent, (p.seconds // c.seconds)::BIGINT AS ratio,
  (SELECT count(DISTINCT (series_key, floor(epoch(ts) / c.seconds))) FROM event_ticks) AS child_bars
FROM tf c JOIN tf p ON p.seconds > c.seconds AND p.seconds % c.seconds = 0""")
def timeframe_lookup(spark, d):
    """Parents, children and step ratios of the cadences, with the bars each child has."""
    tf = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("seconds")) for k, v in CADENCE_SECONDS.items()])).alias("t")).select("t.*")
    c, p = tf.alias("c"), tf.alias("p")
    pairs = c.join(F.broadcast(p), (F.col("p.seconds") > F.col("c.seconds")) & (F.col("p.seconds") % F.col("c.seconds") == 0))  # 7 rows
    pairs = pairs.select(F.col("c.name").alias("child"), F.col("p.name").alias("parent"), (F.col("p.seconds") / F.col("c.seconds")).cast("bigint").alias("ratio"))
    t = event_ticks(spark, d).select("series_key", F.unix_timestamp("ts").alias("s"))
    slots = t.select("series_key", F.explode(F.array(*[F.struct(F.lit(k).alias("child"), F.floor(F.col("s") / v).alias("slot")) for k, v in CADENCE_SECONDS.items()])).alias("r"))
    n = slots.select("series_key", "r.child", "r.slot").distinct().groupBy("child").agg(F.count("*").alias("child_bars"))
    return pairs.join(n, "child")


# --- rollups ----------------------------------------------------------------------------

_POST_COLS = "sentiment_score sentiment_volatility subjectivity avg_score total_score avg_comments total_comments avg_upvote_ratio"
_POST_SQL = """SELECT date_trunc('hour', ts) AS ts, coalesce((avg(polarity) + 1) / 2, 0.5) AS sentiment_score,
  coalesce(stddev_samp(polarity), 0.5) AS sentiment_volatility, count(polarity) AS post_count, coalesce(avg(subjectivity), 0.5) AS subjectivity,
  coalesce(avg(score), 0.5) AS avg_score, coalesce(sum(score), 0.5) AS total_score, coalesce(avg(comments), 0.5) AS avg_comments,
  coalesce(sum(comments), 0.5) AS total_comments, coalesce(avg(upvote_ratio), 0.5) AS avg_upvote_ratio FROM posts GROUP BY 1"""
_NEWS_SQL = """SELECT date_trunc('hour', ts) AS ts, coalesce((avg(polarity) + 1) / 2, 0.5) AS news_sentiment,
  coalesce(stddev_samp(polarity), 0.5) AS news_sentiment_volatility, count(polarity) AS news_article_count,
  coalesce(avg(subjectivity), 0.5) AS news_subjectivity FROM posts WHERE forum = 'view' GROUP BY 1"""


@query("hourly_post_rollup", f"WITH {POSTS} SELECT * REPLACE (epoch(ts)::BIGINT AS ts) FROM ({_POST_SQL})", _POST_COLS)
def hourly_post_rollup(spark, d):
    return epoch(ro.post_rollup(posts(spark, d)))


@query("hourly_news_rollup", f"WITH {POSTS} SELECT * REPLACE (epoch(ts)::BIGINT AS ts) FROM ({_NEWS_SQL})",
       "news_sentiment news_sentiment_volatility news_subjectivity")
def hourly_news_rollup(spark, d):
    return epoch(ro.news_rollup(posts(spark, d).where("forum = 'view'")))


@query("sentiment_combine", f"""WITH {POSTS}, {EVENT_TICKS}, r AS ({_POST_SQL}), n AS ({_NEWS_SQL}),
g AS (SELECT date_trunc('day', ts) AS ts, floor(avg(polarity) * 50 + 50) AS fear_greed_index FROM posts GROUP BY 1),
spine AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts FROM event_ticks),
a AS (SELECT s.ts, r.sentiment_score AS reddit_sentiment, coalesce(r.post_count, 0) AS rv, coalesce(r.total_comments, 0) AS re,
  n.news_sentiment, coalesce(n.news_article_count, 0) AS nv, g.fear_greed_index
  FROM spine s ASOF LEFT JOIN r ON s.ts >= r.ts ASOF LEFT JOIN n ON s.ts >= n.ts ASOF LEFT JOIN g ON s.ts >= g.ts),
c AS (SELECT *, 0.3 * coalesce(reddit_sentiment, 0.5) + 0.3 * coalesce(news_sentiment, 0.5) + 0.4 * coalesce(fear_greed_index / 100.0::DOUBLE, 0.5) AS s FROM a)
SELECT {TS}, s AS sentiment_score, greatest(rv + nv * 10, 100)::BIGINT AS tweet_volume, rv::BIGINT AS reddit_posts, nv::BIGINT AS news_articles,
  coalesce(fear_greed_index, 50)::BIGINT AS fear_greed_index, least(greatest(s * 1.2 - 0.1, 0), 1) AS bullish_ratio,
  1 - least(greatest(s * 1.2 - 0.1, 0), 1) AS bearish_ratio, least((rv + nv) / 1000.0::DOUBLE, 1) AS social_dominance,
  least(re / greatest(rv, 1) / 50, 1) AS engagement_rate FROM c""",
       "sentiment_score bullish_ratio bearish_ratio social_dominance engagement_rate")
def sentiment_combine(spark, d):
    p = posts(spark, d)
    b = p.agg(F.date_trunc("hour", F.min("ts")).alias("start"), F.date_trunc("hour", F.max("ts")).alias("end"))
    spine = jn.time_spine(b, "1 HOUR")
    reddit = ro.post_rollup(p).select("ts", F.col("sentiment_score").alias("reddit_sentiment"), F.col("post_count").alias("reddit_volume"), F.col("total_comments").alias("reddit_engagement"))
    news = ro.news_rollup(p.where("forum = 'view'")).select("ts", "news_sentiment", F.col("news_article_count").alias("news_volume"))
    fear = p.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.floor(F.avg("polarity") * 50 + 50).alias("fear_greed_index"))
    fear = ro.fear_greed_scale(fear).withColumnRenamed("fear_greed_normalized", "fear_greed_sentiment")
    aligned = jn.align_sources(spine, {"reddit": reddit, "news": news, "fear_greed": fear}, keys=[], bucket=Slices(30 * 86400))
    return epoch(ro.sentiment_combine(aligned)).select(
        "ts", "sentiment_score", "tweet_volume", "reddit_posts", "news_articles", "fear_greed_index", "bullish_ratio",
        "bearish_ratio", "social_dominance", "engagement_rate",
    )


@query("fear_greed_scale", f"""WITH {POSTS} SELECT post_id, (polarity * 50 + 50) / 100.0 AS fear_greed_normalized FROM posts""", "fear_greed_normalized")
def fear_greed_scale(spark, d):
    p = posts(spark, d).select("post_id", (F.col("polarity") * 50 + 50).alias("fear_greed_index"))
    return ro.fear_greed_scale(p).drop("fear_greed_index")


# Words that occur in the test texts, as positive and negative entries.
_POS, _NEG = ["the", "is", "la", "und"], ["of", "that", "le", "die"]
_LEX = ", ".join([f"('{w}', 1.0)" for w in _POS] + [f"('{w}', -1.0)" for w in _NEG])


@query("lexicon_polarity", f"""WITH lex(word, polarity) AS (VALUES {_LEX}),
t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
w AS (SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM t),
c AS (SELECT id, w.word, polarity FROM w LEFT JOIN lex USING (word) WHERE w.word <> '')
SELECT id, coalesce(avg(polarity), 0.0)::DOUBLE AS polarity, count(polarity)::DOUBLE / count(*) AS subjectivity, count(*) AS n_words FROM c GROUP BY 1""",
       "polarity subjectivity")
def lexicon_polarity(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    conv = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return ro.lexicon_polarity(docs.unionByName(conv), "id", "text", ro.lexicon_table(spark, _POS, _NEG))


@query("gradient", f"""WITH {ORDER_DAYS}, {BARS_D} SELECT series_key, {TS},
  CASE WHEN lag(close) OVER w IS NULL THEN lead(close) OVER w - close WHEN lead(close) OVER w IS NULL THEN close - lag(close) OVER w
    ELSE (lead(close) OVER w - lag(close) OVER w) / 2 END AS close_gradient,
  high - low AS net_flow, close - open AS yield_spread FROM bars WINDOW w AS ({W})""", "close_gradient net_flow yield_spread")
def gradient(spark, d):
    g = ro.gradient(bars_d(spark, d), "close", "close_gradient")
    return epoch(g.select("series_key", "ts", "close_gradient", (F.col("high") - F.col("low")).alias("net_flow"), (F.col("close") - F.col("open")).alias("yield_spread")))


# --- correlation and selection ----------------------------------------------------------

def _feature_rows(spark, d):
    """Bars with a few features and one aligned external column."""
    from tideline.operators.indicators import add_features, bollinger_features, lag_features, return_features

    b = add_features(bars_d(spark, d), [return_features(), lag_features(("close",), (1, 2)), bollinger_features()])
    b = b.select("series_key", "ts", "open", "high", "low", "close", "volume", "returns", "close_lag_1", "close_lag_2", "bb_middle")
    return b.join(order_days(spark, d).select("ts", "avg_price"), "ts", "left")


_FEATURES = ["open", "high", "low", "volume", "returns", "close_lag_1", "close_lag_2", "bb_middle", "avg_price"]
_ROWS = f"""{BARS_D}, {ORDER_DAYS}, rows AS (SELECT b.series_key, b.ts, open, high, low, close, volume,
  close / lag(close) OVER ({W}) - 1 AS returns, lag(close) OVER ({W}) AS close_lag_1, lag(close, 2) OVER ({W}) AS close_lag_2,
  CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) = 20 THEN avg(close) OVER ({W} ROWS 19 PRECEDING) END AS bb_middle, avg_price
  FROM bars b LEFT JOIN order_days USING (ts))"""
_PAIRS = [(a, b) for i, a in enumerate([*_FEATURES, "close"]) for b in [*_FEATURES, "close"][i + 1:]]
_MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS left_column, '{b}' AS right_column, corr({a}, {b}) AS r FROM rows" for a, b in _PAIRS)


@query("corr_matrix", f"WITH {_ROWS} {_MATRIX}", "r")
def corr_matrix(spark, d):
    return sel.corr_matrix(_feature_rows(spark, d), [*_FEATURES, "close"])


@query("corr_summary", f"""WITH {_ROWS}, m AS ({_MATRIX}) SELECT max(abs(r)) AS max_abs_r, avg(abs(r)) AS mean_abs_r, count(*) FILTER (abs(r) > 0.3) AS high_pairs,
  CASE WHEN count(*) FILTER (abs(r) > 0.3) > 5 THEN '{qu.ADVICE_CORRELATED}' END AS advice FROM m""", "max_abs_r mean_abs_r")
def corr_summary(spark, d):
    return qu.correlation_summary(sel.corr_matrix(_feature_rows(spark, d), [*_FEATURES, "close"]), high=0.3)


@query("high_corr_pairs", f"WITH {_ROWS} SELECT * FROM ({_MATRIX}) WHERE abs(r) > 0.5", "r")
def high_corr_pairs(spark, d):
    return sel.high_corr_pairs(sel.corr_matrix(_feature_rows(spark, d), [*_FEATURES, "close"]), 0.5)


_TARGET = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, close)) AS abs_r FROM rows" for c in _FEATURES)


@query("feature_target_corr", f"WITH {_ROWS} {_TARGET}", "abs_r")
def feature_target_corr(spark, d):
    return sel.target_corr(_feature_rows(spark, d), _FEATURES, "close")


@query("top_k_features", f"WITH {_ROWS} SELECT * FROM ({_TARGET}) ORDER BY abs_r DESC, feature LIMIT 3", "abs_r")
def top_k_features(spark, d):
    return sel.target_corr(_feature_rows(spark, d), _FEATURES, "close").orderBy(F.desc("abs_r"), "feature").limit(3)


@query("pearson_score", f"WITH {_ROWS}, rows2 AS (SELECT * FROM rows WHERE returns IS NOT NULL AND close_lag_2 IS NOT NULL AND bb_middle IS NOT NULL AND avg_price IS NOT NULL) "
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, close)) AS abs_r FROM rows2" for c in _FEATURES), "abs_r")
def pearson_score(spark, d):
    return sel.target_corr(_feature_rows(spark, d).na.drop(), _FEATURES, "close")


@query("f_score", f"WITH {_ROWS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, close)) AS abs_r, pow(corr({c}, close), 2) / (1 - pow(corr({c}, close), 2)) * (count({c}) - 2) AS f FROM rows" for c in _FEATURES),
    "abs_r f")
def f_score(spark, d):
    return sel.f_score(_feature_rows(spark, d), _FEATURES, "close")


_WIDTHS = {"volume": 10.0, "returns": 0.01, "n_orders": 2.0, "filled": 20000.0}
_BINS = {c: _WIDTHS.get(c, 2000.0) for c in _FEATURES}
_MI = " UNION ALL ".join(f"""SELECT '{c}' AS feature, greatest(sum(n / t * ln(n * t / (nx * ny))), 0.0) AS mi FROM (
  SELECT n::DOUBLE AS n, sum(n) OVER () ::DOUBLE AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny FROM (
    SELECT floor({c} / {b}) AS x, floor(close / 2000) AS y, count(*) AS n FROM rows WHERE {c} IS NOT NULL AND close IS NOT NULL GROUP BY 1, 2))""" for c, b in _BINS.items())


@query("mutual_info", f"WITH {_ROWS} {_MI}", "mi")
def mutual_info(spark, d):
    """Binned estimate; fixed-width bins here, so that SQL can state the same result."""
    r = _feature_rows(spark, d)
    binned = r.select(F.floor(F.col("close") / 2000).alias("close"), *[F.floor(F.col(c) / b).alias(c) for c, b in _BINS.items()])
    return sel.binned_mutual_info(binned, list(_BINS), "close")


def _quantile_bins_sql(columns: list[str], source: str, bins: int = 10) -> str:
    cut = lambda c: "list_sort(list_distinct([" + ", ".join(f"quantile_cont({c}::DOUBLE, {i / bins})" for i in range(1, bins)) + "]))"
    return (f"qc AS (SELECT {', '.join(f'{cut(c)} AS q_{c}' for c in columns)} FROM {source}), "
            f"qb AS (SELECT {', '.join(f'CASE WHEN {c} IS NOT NULL THEN len(list_filter(q_{c}, lambda q: q <= {c}::DOUBLE)) END AS {c}' for c in columns)} FROM {source}, qc)")


def _mi_sql(columns: list[str], source: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, greatest(sum(n / t * ln(n * t / (nx * ny))), 0.0) AS mi FROM (
  SELECT n::DOUBLE AS n, sum(n) OVER () ::DOUBLE AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny FROM (
    SELECT {c} AS x, close AS y, count(*) AS n FROM {source} WHERE {c} IS NOT NULL AND close IS NOT NULL GROUP BY 1, 2))""" for c in columns)


@query("mutual_info_quantile_bins", f"WITH {_ROWS}, {_quantile_bins_sql([*_FEATURES, 'close'], 'rows')} {_mi_sql(_FEATURES, 'qb')}", "mi", digits=5)
def mutual_info_quantile_bins(spark, d):
    r = written(_feature_rows(spark, d).select(*_FEATURES, "close"), "feature-rows")  # three passes read them
    return sel.binned_mutual_info(sel.quantile_bins(r, [*_FEATURES, "close"]), _FEATURES, "close")


@query("combined_score", f"""WITH {_ROWS}, f AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, close)) AS abs_r, pow(corr({c}, close), 2) / (1 - pow(corr({c}, close), 2)) * (count({c}) - 2) AS f FROM rows" for c in _BINS)}),
m AS ({_MI}) SELECT feature, abs_r, mi, f, (abs_r + mi + f / (SELECT max(f) FROM f)) / 3 AS score FROM f JOIN m USING (feature)""",
       "abs_r mi f score")
def combined_score(spark, d):
    r = _feature_rows(spark, d)
    binned = r.select(F.floor(F.col("close") / 2000).alias("close"), *[F.floor(F.col(c) / b).alias(c) for c, b in _BINS.items()])
    return sel.combined_score(sel.f_score(r, list(_BINS), "close"), sel.binned_mutual_info(binned, list(_BINS), "close"))


_COMPLETE = "rows2 AS (SELECT * FROM rows WHERE returns IS NOT NULL AND close_lag_2 IS NOT NULL AND bb_middle IS NOT NULL AND avg_price IS NOT NULL)"


def _greedy_sql(threshold: float) -> str:
    """``kept``: the list of features that the greedy rule keeps, strongest first."""
    pairs = [(a, b) for i, a in enumerate(_FEATURES) for b in _FEATURES[i + 1:]]
    matrix = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM rows2" for a, b in pairs)
    strength = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, close)) AS abs_r FROM rows2" for c in _FEATURES)
    return f"""strength AS ({strength}), cm AS ({matrix}),
clash AS (SELECT a AS feature, list(b) AS bad FROM (SELECT a, b, r FROM cm UNION ALL SELECT b, a, r FROM cm) WHERE abs(r) > {threshold} GROUP BY 1),
ranked AS (SELECT feature, row_number() OVER (ORDER BY abs_r DESC, feature) AS k, coalesce(bad, []::VARCHAR[]) AS bad FROM strength LEFT JOIN clash USING (feature)),
greedy AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept
  UNION ALL SELECT ranked.k, CASE WHEN len(list_intersect(kept, bad)) = 0 THEN list_append(kept, feature) ELSE kept END FROM greedy JOIN ranked ON ranked.k = greedy.k + 1),
kept AS (SELECT unnest(kept) AS feature FROM greedy WHERE k = {len(_FEATURES)})"""


@query("drop_collinear", f"WITH RECURSIVE {_ROWS}, {_COMPLETE}, {_greedy_sql(0.5)} SELECT feature, abs_r FROM strength JOIN kept USING (feature)", "abs_r")
def drop_collinear(spark, d):
    """Names kept by the greedy rule, with their strength."""
    r = _feature_rows(spark, d).na.drop()
    return sel.drop_collinear(sel.target_corr(r, _FEATURES, "close"), sel.corr_matrix(r, _FEATURES), 0.5)


_F2 = " UNION ALL ".join(f"SELECT '{c}' AS feature, pow(corr({c}, close), 2) / (1 - pow(corr({c}, close), 2)) * (count({c}) - 2) AS f FROM rows2" for c in _FEATURES)


@query("fit_select", f"""WITH RECURSIVE {_ROWS}, {_COMPLETE}, {_greedy_sql(0.9)}, {_quantile_bins_sql([*_FEATURES, 'close'], 'rows2')},
fs AS (SELECT * FROM ({_F2}) JOIN kept USING (feature)), mi AS ({_mi_sql(_FEATURES, 'qb')}),
al AS (SELECT feature, abs_r, mi, f, (abs_r + mi + f / (SELECT max(f) FROM fs)) / 3 AS score FROM fs JOIN strength USING (feature) JOIN mi USING (feature))
SELECT * FROM al ORDER BY score DESC, feature LIMIT 5""", "abs_r mi f score", digits=5)
def fit_select(spark, d):
    return sel.fit_select(_feature_rows(spark, d), _FEATURES, "close", k=5)


_ROLES = {"avg_price": "orders", "n_orders": "orders", "filled": "orders"}


@query("source_feature_count", f"""WITH {_ROWS} SELECT 'orders' AS source, 1::BIGINT AS n_features, count(avg_price) AS n_values FROM rows
UNION ALL SELECT 'price', 9::BIGINT, (count(open) + count(high) + count(low) + count(close) + count(volume) + count(returns)
  + count(close_lag_1) + count(close_lag_2) + count(bb_middle))::BIGINT FROM rows""")
def source_feature_count(spark, d):
    return sel.source_counts(_feature_rows(spark, d).drop("series_key", "ts"), _ROLES)


@query("source_impact_summary", f"""WITH {_ROWS}, t AS ({_TARGET}) SELECT
  count(*) FILTER (feature = 'avg_price') AS n_external, count(*) FILTER (feature <> 'avg_price') AS n_price,
  avg(abs_r) FILTER (feature = 'avg_price') AS external_abs_r, avg(abs_r) FILTER (feature <> 'avg_price') AS price_abs_r,
  avg(abs_r) FILTER (feature = 'avg_price') / avg(abs_r) FILTER (feature <> 'avg_price') AS impact_ratio FROM t""",
       "external_abs_r price_abs_r impact_ratio")
def source_impact_summary(spark, d):
    return sel.source_impact(sel.target_corr(_feature_rows(spark, d), _FEATURES, "close"), _ROLES)
