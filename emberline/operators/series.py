"""Daily series of topics, trend labels and growth predictions over observed dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topics import KEYS


def topic_daily(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per topic and local date: rows, distinct authors (an empty one counts), reposts, and references of that date."""
    refs = edges.where("target_tweet_id <> '' and local_date <> ''").groupBy(F.col("target_tweet_id").alias("tweet_id"), "local_date").agg(F.count(F.lit(1)).alias("refs"))
    p = posts.where("local_date <> ''").join(refs, ["tweet_id", "local_date"], "left")
    p = p.select("local_date", "author", F.coalesce("public_metrics.repost_count", F.lit(0)).alias("reposts"), F.coalesce("refs", F.lit(0)).alias("refs"), "entities", "url_domains")

    def of(kind: str, array: str) -> DataFrame:
        return p.select(F.lit(kind).alias("topic_type"), F.explode(array).alias("topic_key"), "local_date", "author", "reposts", "refs").where("topic_key <> ''")

    rows = of("hashtag", "entities.hashtags").unionByName(of("cashtag", "entities.cashtags")).unionByName(of("domain", "url_domains"))
    days = rows.groupBy(*KEYS, "local_date").agg(F.count(F.lit(1)).alias("tweet_cnt"), F.countDistinct("author").alias("unique_author_cnt"), F.sum("reposts").alias("sum_repost_cnt"), F.sum("refs").alias("ref_cnt"))
    zero = F.lit(0).cast("long")
    centre = refs.select(F.lit("center_tweet").alias("topic_type"), F.col("tweet_id").alias("topic_key"), "local_date", zero.alias("tweet_cnt"), zero.alias("unique_author_cnt"), zero.alias("sum_repost_cnt"), F.col("refs").alias("ref_cnt"))
    return days.unionByName(centre)


def date_axis(daily: DataFrame) -> DataFrame:
    """local_date and back: 1 for the last observed date, 2 for the one before, and so on.  One row a date."""
    dates = daily.select("local_date").distinct()
    return dates.withColumn("back", F.row_number().over(Window.orderBy(F.desc("local_date"))))


def _wide(daily: DataFrame, topics: DataFrame, deepest: int) -> tuple[DataFrame, DataFrame]:
    """Per topic key the measures of the last dates, zero-filled, by one conditional aggregate; and the axis."""
    axis = date_axis(daily)
    n = axis.where(F.col("back") <= deepest).agg(F.count(F.lit(1)).alias("n_dates"))
    dated = daily.join(axis, "local_date")
    cells = []
    for name, c in (("a", "unique_author_cnt"), ("t", "tweet_cnt")):
        cells += [F.sum(F.when(F.col("back") == i, F.col(c)).otherwise(0)).alias(f"{name}{i}") for i in range(1, deepest + 1)]
    wide = dated.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_days"), *cells)
    wide = topics.select(*KEYS).distinct().join(wide, KEYS, "left")
    return wide.join(F.broadcast(n)).fillna(0), n  # one row


def topic_trends(daily: DataFrame, topics: DataFrame) -> DataFrame:
    """Labelled topics with today_value and avg_7d (mean authors over up to seven earlier observed dates)."""
    wide, _ = _wide(daily, topics, 8)
    a, t, n = F.col("a1"), F.col("t1"), F.col("n_dates") - 1
    mean = sum((F.col(f"a{i}") for i in range(2, 9)), F.lit(0)) / n
    most_a = F.greatest(*(F.col(f"a{i}") for i in range(2, 9)))
    most_t = F.greatest(*(F.col(f"t{i}") for i in range(2, 9)))
    w = wide.where("n_dates >= 2").withColumns({"avg_7d": mean})
    m = F.col("avg_7d")
    label = (
        F.when(~((a >= 1) | (t >= 2)), None)
        .when((a > 0) & (m == 0), "Emerging")
        .when((a >= 1.5 * m) & ((a >= 2) | (t >= 2)), "Rising")
        .when((a >= 3) | (t >= 5), F.when((a >= most_a) | (t >= most_t), "Peak"))
        .when((a <= 0.5 * m) & (m > 0), "Fading")
        .when((a >= 0.8 * m) & (a <= 1.2 * m) & ((m >= 2) | (t >= 3)), "Persistent")
    )
    return w.withColumn("trend_label", label).where("trend_label is not null").select(*KEYS, "trend_label", a.alias("today_value"), "avg_7d")


def growth_by_steps(daily: DataFrame, topics: DataFrame) -> DataFrame:
    """Prediction from one-date growth, three-date means and acceleration; needs three observed dates."""
    wide, _ = _wide(daily, topics, 4)
    w = wide.where("n_dates >= 3")
    k = F.least(F.col("n_dates") - 1, F.lit(3))
    a, t, y, ty = F.col("a1"), F.col("t1"), F.col("a2"), F.col("t2")
    mean_a, mean_t = ((F.col(f"{c}2") + F.col(f"{c}3") + F.col(f"{c}4")) / k for c in "at")
    w = w.withColumns({"g1": a - y, "h1": t - ty, "m3": mean_a, "mt3": mean_t})
    w = w.withColumns({"g3": F.when(F.col("m3") > 0, a - F.col("m3")).otherwise(0.0), "h3": F.when(F.col("mt3") > 0, t - F.col("mt3")).otherwise(0.0), "acc": F.when(F.col("m3") > 0, F.col("g1") - (y - F.col("m3"))).otherwise(0.0)})
    g1, h1, g3, acc = (F.col(c) for c in ("g1", "h1", "g3", "acc"))
    rules = [
        ((a == 0) & (t == 0), "fade", 0.8),
        ((g1 > 2) & (h1 > 2), "grow", 0.75),
        ((g1 > 0) & (acc > 0), "grow", 0.65),
        ((g1 < -1) | (h1 < -2), "fade", 0.7),
        ((F.abs(g1) <= 1) & (F.abs(h1) <= 2), "stabilize", 0.6),
        ((g3 > 0) & (a >= 2), "grow", 0.55),
        (g3 < 0, "fade", 0.6),
    ]
    return _predicted(w.where("n_days > 0"), rules, F.lit(0.5)).select(*KEYS, "prediction", "confidence", F.col("g1").alias("author_growth_1d"), F.col("h1").alias("tweet_growth_1d"), F.col("g3").alias("author_growth_3d"), F.col("h3").alias("tweet_growth_3d"), F.col("acc").alias("acceleration"))


def growth_by_momentum(daily: DataFrame, topics: DataFrame) -> DataFrame:
    """Prediction from growth rate and momentum over three and seven dates, with volatility; needs three observed dates."""
    wide, _ = _wide(daily, topics, 8)
    w = wide.where("n_dates >= 3 and n_days > 0")
    n = F.col("n_dates") - 1
    k = F.least(n, F.lit(3))
    a, y = F.col("a1"), F.col("a2")
    m3 = (F.col("a2") + F.col("a3") + F.col("a4")) / k
    m7 = sum((F.col(f"a{i}") for i in range(2, 9)), F.lit(0)) / n
    squares = sum((F.col(f"a{i}") * F.col(f"a{i}") for i in range(2, 9)), F.lit(0)) / n
    w = w.withColumns({"m3": m3, "m7": m7, "sq": squares, "rate": F.when(y > 0, (a - y) / y).otherwise(0.0)})
    w = w.withColumns({"mom3": (a - F.col("m3")) / (F.col("m3") + 1), "mom7": (a - F.col("m7")) / (F.col("m7") + 1), "volatility": F.sqrt(F.greatest(F.col("sq") - F.col("m7") * F.col("m7"), F.lit(0.0)))})
    rate, mom3, mom7 = F.col("rate"), F.col("mom3"), F.col("mom7")
    sure = lambda top, base, slope, x: F.least(F.lit(top), base + slope * x)
    rules = [
        ((rate > 0.5) & (a >= 2), "grow", sure(0.9, 0.5, 0.1, rate)),
        ((mom3 > 0.3) & (a >= 2), "grow", sure(0.85, 0.5, 0.15, mom3)),
        ((mom7 > 0.2) & (a >= 3), "grow", sure(0.8, 0.5, 0.1, mom7)),
        ((rate < -0.3) & (a < y), "fade", sure(0.9, 0.5, 0.1, F.abs(rate))),
        ((mom3 < -0.2) & (a < F.col("m3")), "fade", sure(0.85, 0.5, 0.15, F.abs(mom3))),
        ((mom7 < -0.15) & (a < F.col("m7")), "fade", sure(0.8, 0.5, 0.1, F.abs(mom7))),
        ((F.abs(mom7) < 0.1) & (a >= 2), "stabilize", 0.7),
    ]
    out = _predicted(w, rules, F.lit(0.5))
    confidence = F.bround(F.when(a < 2, F.col("confidence") * 0.7).otherwise(F.col("confidence")), 3)
    return out.select(*KEYS, "prediction", confidence.alias("confidence"), "rate", "mom3", "mom7", "volatility")


def _predicted(w: DataFrame, rules, default) -> DataFrame:
    prediction, confidence = F.lit("stabilize"), default
    for when, outcome, sure in reversed(rules):
        prediction = F.when(when, outcome).otherwise(prediction)
        confidence = F.when(when, sure).otherwise(confidence)
    return w.withColumns({"prediction": prediction, "confidence": confidence.cast("double")})


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
