"""The last day's posts are cleaned without those before it, and are the same."""

from pyspark.sql import functions as F

from emberline.operators import normalize as N
from emberline.plans.daily_topics import DailyTopics
from emberline.sources import posts as src

SF = "/root/testdata/sf0.001"


def repeated(spark):
    """News posts; some ids have an older or a younger record, one at the edge of the day, and some have none."""
    p = src.news_posts(spark, SF)
    n = F.col("tweet_id").cast("long")
    old = p.where(n % 5 == 0).withColumns({"created_at": F.lit("2024-01-02T00:00:00Z"), "text": F.lit("an older record")})
    young = p.where(n % 7 == 0).withColumns({"created_at": F.lit("2024-01-30T20:00:00Z"), "text": F.lit("a younger record")})
    none = p.where(n % 11 == 0).withColumn("tweet_id", F.lit("")).withColumn("created_at", F.lit("2024-03-01T00:00:00Z"))
    return p.unionByName(old).unionByName(young).unionByName(none).unionByName(p.where(n % 13 == 0).withColumn("created_at", F.lit("unreadable")))


def shown(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(df.columns)))).collect())


def test_recent_records_are_cleaned_as_all_are(spark):
    posts, roster = repeated(spark).cache(), src.roster(spark, SF)
    for who in (roster, None):
        for seconds in (3600, 24 * 3600, 40 * 24 * 3600):
            want = shown(N.recent(N.clean(posts, who), seconds))
            assert want and shown(N.clean_recent(posts, who, seconds)) == want


def test_the_day_is_made_without_all_posts_cleaned(spark):
    run = DailyTopics(repeated(spark), src.roster(spark, SF))
    day = shown(run.day)
    assert "clean" not in run.__dict__
    whole = DailyTopics(repeated(spark), src.roster(spark, SF))
    assert shown(N.recent(whole.clean, whole.short)) == day == shown(whole.day)
