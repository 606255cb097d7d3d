"""The account pool: seeds, expansion by relations, and the union of both."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assets import NOISY_BIO
from ..functions.scalars import norm_username
from ..sources.stages import staged


def seed_scores(pool: DataFrame, least_followers: int = 200) -> DataFrame:
    """Accounts that aren't noise, with seedscore: 3 per list, log followers, 1 if verified."""
    followers = F.coalesce("followers_count", F.lit(0))
    noisy = (followers < least_followers) | F.coalesce("bio", F.lit("")).rlike("(?i)" + "|".join(re.escape(p) for p in NOISY_BIO))
    score = 3 * F.coalesce("list_appearances", F.lit(0)) + F.log1p(followers) + F.when(F.coalesce("verified", F.lit(False)), 1).otherwise(0)
    return pool.where(~noisy).withColumn("seedscore", score)


def select_seeds(pool: DataFrame, n: int = 100, exact: bool = True) -> DataFrame:
    """The n best accounts, ties by name; fewer than n are an error unless exact is off.

    With exact the accounts found are written (n rows), so that counting and reading them takes one run of the plan.
    """
    best = seed_scores(pool).orderBy(F.desc("seedscore"), "username").limit(n)
    if exact:
        best = staged(best, "seeds")
        if best.count() != n:
            raise ValueError(f"the pool has fewer than {n} accounts that qualify")
    return best


def expansion_candidates(edges: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """Accounts outside the seeds that at least so many seeds follow, mention or interact with, with the evidence."""
    e = edges.select("kind", norm_username(F.col("seed_username")).alias("seed"), norm_username(F.col("target_username")).alias("username"))
    names = seeds.select(norm_username(F.col("username")).alias("seed")).distinct()
    e = e.where("username <> ''").join(names, "seed", "left_semi").distinct()
    e = e.join(names.withColumnRenamed("seed", "username"), "username", "left_anti")
    by = lambda k: F.when(F.col("kind") == k, F.col("seed"))
    kinds = ("followed", "mentioned", "interacted")
    out = e.groupBy("username").agg(
        *(F.count(by(k)).alias(f"cnt_{k}_by_seeds") for k in kinds), *(F.array_sort(F.collect_set(by(k))).alias(f"seed_usernames_{k}") for k in kinds)
    )
    return out.where(" or ".join(f"cnt_{k}_by_seeds >= {least}" for k in kinds))


def expansion_scores(found: DataFrame) -> DataFrame:
    return found.withColumn("expandscore", (2 * F.col("cnt_interacted_by_seeds") + F.col("cnt_mentioned_by_seeds") + F.col("cnt_followed_by_seeds")).cast("double"))


def account_pool(seeds: DataFrame, found: DataFrame, profiles: DataFrame | None = None, n: int = 400) -> DataFrame:
    """Seeds and the n best of the expansion, ties by name, with their followers where a profile is known."""
    best = expansion_scores(found).orderBy(F.desc("expandscore"), "username").limit(n)
    if profiles is not None:
        best = best.join(profiles.select("username", "followers_count"), "username", "left")
    a = seeds.select("username", "followers_count", "seedscore", F.lit("seed").alias("origin"))
    b = best.select("username", *(["followers_count"] if profiles is not None else []), "expandscore", F.lit("expanded").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)
