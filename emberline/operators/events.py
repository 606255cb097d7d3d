"""Event candidates, the conditions under which two join, anchor clusters and event scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import first_key_rows, shared_key_pairs, text_key

NEAR = 48 * 3600
#: Weights of the prioritised merge conditions: same anchor, entity and action, entity in time, action in time.
SAME_ANCHOR, ENTITY_ACTION, ENTITY_TIME, ACTION_TIME = 10.0, 8.0, 6.0, 4.0


def _sides(pairs: DataFrame, events: DataFrame) -> DataFrame:
    a = events.select(*(F.col(c).alias(f"{c}_a") for c in events.columns))
    b = events.select(*(F.col(c).alias(f"{c}_b") for c in events.columns))
    return pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))


def condition_count(pairs: DataFrame, events: DataFrame, edges: DataFrame, with_action: bool = False) -> DataFrame:
    """pairs(a, b, ...) -> with satisfied: how many of near in time, shared entity, two authors, joined by an edge
    (and, with_action, same action) hold.  events(id, time, entity, author, action); edges(source, target)."""
    linked = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.lit(True).alias("linked")).distinct()
    two = pairs.select(*pairs.columns).withColumns({"__x": F.least("a", "b"), "__y": F.greatest("a", "b")})
    two = two.join(linked.withColumnsRenamed({"a": "__x", "b": "__y"}), ["__x", "__y"], "left").drop("__x", "__y")
    s = _sides(two, events)
    tests = [
        F.abs(F.col("time_a") - F.col("time_b")) <= NEAR,
        F.arrays_overlap("entity_a", "entity_b"),
        (F.col("author_a") != "") & (F.col("author_b") != "") & (F.col("author_a") != F.col("author_b")),
        F.coalesce("linked", F.lit(False)),
    ]
    if with_action:
        tests.append(F.col("action_a") == F.col("action_b"))
    n: Column = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    return s.select(*pairs.columns, n.alias("satisfied"))


def near_pairs(events: DataFrame) -> DataFrame:
    """Pairs (a < b) within NEAR seconds, met in time slots and their neighbours; a full slot is dealt into blocks."""
    pairs = shared_key_pairs(*(_keyed(events, ("time",), wide).withColumnRenamed("id", c) for c, wide in (("a", False), ("b", True))))
    t = events.select("id", "time")
    near = pairs.join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b").where(F.abs(F.col("ta") - F.col("tb")) <= NEAR)
    return near.select("a", "b")


def _keyed(events: DataFrame, keys: tuple[str, ...], wide: bool) -> DataFrame:
    """(id, k), see _keys."""
    return events.select("id", F.explode(_keys(keys, wide)).alias("k"))


def _keys(keys: tuple[str, ...], wide: bool) -> Column:
    """What an event can meet others by.  Times are slots of NEAR seconds; the wide side is in its neighbours' slots too.

    "entity+action", "entity+time" and "action+time" are met only where both are shared.
    """
    at = F.floor(F.col("time") / NEAR)
    slots = F.array(at - 1, at, at + 1) if wide else F.array(at)
    each = lambda kind, a: F.transform(a, lambda x: text_key(kind, x))
    both = lambda kind, a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: text_key(kind, x, y))))
    made = {
        "anchor": lambda: F.array(text_key("n", F.nullif("anchor_id", F.lit("")))),
        "entity": lambda: each("e", F.col("entity")),
        "action": lambda: each("c", F.array("action")),
        "time": lambda: each("t", slots),
        "entity+action": lambda: both("ec", F.col("entity"), F.array("action")),
        "entity+time": lambda: both("et", F.col("entity"), slots),
        "action+time": lambda: both("ct", F.array("action"), slots),
    }
    arrays = [F.coalesce(made[k](), F.array().cast("array<string>")) for k in keys]
    return F.array_distinct(F.array_compact(F.concat(*arrays)))


def _meetings(events: DataFrame, leaders: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """Pairs (a, b) with a before b that share a key; with leaders only those whose first event is one of them."""
    left = _keyed(events if leaders is None else leaders, keys, False).withColumnRenamed("id", "a")
    return shared_key_pairs(left, _keyed(events, keys, True).withColumnRenamed("id", "b"))


def weighted_pairs(events: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """(a, b, weight) with a < b: the first merge condition that holds.  events(id, time, entity, author, action, anchor_id).

    Candidates come from equi-joins on all that a condition needs: the anchor, an entity and the action, an entity
    and a time slot, the action and a time slot; each pair is tested where it is made.  With leaders, rows of events, only pairs
    whose first event is one of them.
    """
    from ..sources.stages import staged

    columns, keys = ["id", "time", "entity", "author", "action", "anchor_id"], ("anchor", "entity+action", "entity+time", "action+time")
    e = events.select(columns)
    e = staged(e, "events") if leaders is None else e
    under = lambda rows, side, wide: rows.select(*(F.col(c).alias(f"{c}_{side}") for c in columns), _keys(keys, wide).alias(f"keys_{side}")).withColumn("k", F.explode(f"keys_{side}"))
    s = first_key_rows(under(e if leaders is None else leaders, "a", False), under(e, "b", True)).withColumnsRenamed({"id_a": "a", "id_b": "b"})
    near = F.abs(F.col("time_a") - F.col("time_b")) <= NEAR
    shared, same = F.arrays_overlap("entity_a", "entity_b"), F.coalesce(F.col("action_a") == F.col("action_b"), F.lit(False))
    weight = (
        F.when((F.col("anchor_id_a") == F.col("anchor_id_b")) & (F.col("anchor_id_a") != ""), SAME_ANCHOR)
        .when(shared & same, ENTITY_ACTION)
        .when(shared & near, ENTITY_TIME)
        .when((F.col("author_a") != F.col("author_b")) & (F.col("author_a") != "") & (F.col("author_b") != "") & near & same, ACTION_TIME)
    )
    return s.select("a", "b", weight.alias("weight")).where("weight is not null")


def condition_pairs(events: DataFrame, edges: DataFrame, leaders: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(a, b, satisfied) with a < b and at least two of: shared entity, same action, near in time, two authors, joined by an edge.

    Two authors alone are one condition, so every such pair meets in an entity, an action, a time slot or an edge.
    """
    e = events.select("id", "time", "entity", "author", "action")
    joined = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct()
    if leaders is not None:
        joined = joined.join(leaders.select(F.col("id").alias("a")), "a", "left_semi")
    pairs = _meetings(e, leaders, ("entity", "action", "time")).unionByName(joined.select("a", "b")).distinct()
    return condition_count(pairs, e, edges, with_action=True).where(F.col("satisfied") >= least)


def _placed(events: DataFrame, rows: int = 100_000) -> DataFrame:
    """events with place: 0, 1, ... in order of id, over ranges of about so many rows; the driver sees one row a range."""
    from ..sources.stages import staged

    parts = max(1, -(-events.count() // rows))
    ids = events.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id").select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    ids = staged(ids, "order")
    counts = ids.groupBy("part").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    start, first = 0, []
    for r in counts:
        first.append((r["part"], start - r["least"]))
        start += r["n"]
    moved = events.sparkSession.createDataFrame(first, "part int, moved long")
    return events.join(ids.join(F.broadcast(moved), "part").select("id", (F.col("row") + F.col("moved")).alias("place")), "id")


def _followers(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of a block, a before b, few enough for one task -> (id): who, in order of id, finds a leader before it."""
    kind = dict(pairs.dtypes)["a"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        names = both.dictionary
        order = pc.sort_indices(names).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        a, b = np.split(place[both.indices.to_numpy()], 2)
        by = np.argsort(b, kind="stable")
        a, b = a[by], b[by]
        lead = np.ones(len(order), bool)
        who, start = np.unique(b, return_index=True)
        for x, lo, hi in zip(who, start, [*start[1:], len(b)]):
            lead[x] = not lead[a[lo:hi]].any()  # all of them come before x
        yield pa.RecordBatch.from_arrays([names.take(pa.array(order[np.flatnonzero(~lead)]))], ["id"])

    return pairs.select("a", "b").repartition(1).mapInArrow(settle, f"id {kind}")


def block_leaders(events: DataFrame, pairs, block: int = 1000, by_weight: bool = False, most: int = 2_000_000) -> DataFrame:
    """Leader clustering of events(id, ...), ids distinct, in order of id, without the table of all pairs: (id, leader, weight).

    pairs(leaders, events) gives (a, b, weight) for compatible events b later than a leader a.  A round settles the
    open events of the next `block` places among themselves, then joins the new leaders to the later events.  The block
    doubles as long as its inner pairs are few, and halves beyond `most` of them, so n events that seldom meet take
    about log n rounds.  Up to `most` inner pairs are settled in one task, more by rounds of joins, which follow the longest
    chain of events that wait for each other.  Settled events leave the table of open ones.  A hot entity or time slot costs its events times
    the leaders in it, not its events squared.  Followers join the earliest leader, or (by_weight) the heaviest; a leader has weight 0.
    """
    from ..sources.stages import staged
    from .cluster import leaders as settle

    opened = staged(_placed(events), "open")
    all_ = opened if by_weight else None  # the heaviest leader may be one of a later block
    found, led, at, least = None, None, 0, block
    while not opened.isEmpty():
        head = staged(opened.where((F.col("place") >= at) & (F.col("place") < at + block)), "block")
        at += block
        inner = staged(pairs(head, head), "meetings")
        n = inner.count()
        if 0 < n <= most:
            new = staged(head.join(_followers(inner), "id", "left_anti"), "leaders")
        elif n:
            fixed = settle(head.select("id", F.col("id").alias("ord")), inner.select(F.col("a").alias("leader"), F.col("b").alias("follower"), "weight"))
            new = staged(head.join(fixed.where("id = leader").select("id"), "id", "left_semi"), "leaders")
        else:
            new = head
        rest = opened if all_ is None else all_.where(F.col("place") >= at - block)
        hits = staged(pairs(new, rest), "hits")
        led = new.select("id") if led is None else led.unionByName(new.select("id"))
        found = hits if found is None else found.unionByName(hits)
        opened = staged(opened.where(F.col("place") >= at).join(hits.select(F.col("b").alias("id")), "id", "left_anti"), "open")
        block = 2 * block if 4 * n <= most else max(least, block // 2) if n > most else block
    if led is None:
        return events.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("weight"))
    # struct minimum: the heaviest, then the earliest leader
    best = F.min(F.struct((-F.col("weight") if by_weight else F.lit(0.0)).alias("o"), F.col("a").alias("leader"), "weight")).alias("best")
    joins = found.groupBy(F.col("b").alias("id")).agg(best).select("id", "best.leader", "best.weight")
    own = led.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("weight"))
    return own.unionByName(joins.join(led, "id", "left_anti"))


def kept_clusters(found: DataFrame, least: int = 2, prefix: str = "") -> DataFrame:
    """(id, leader, weight) -> (cluster_id, id, cluster_weight) of clusters of at least so many; the weight is the greatest."""
    size = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("cluster_weight")).where(F.col("n") >= least)
    return found.join(size, "leader").select(F.concat(F.lit(prefix), F.col("leader").cast("string")).alias("cluster_id"), "id", "cluster_weight")


def anchor_clusters(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Posts that refer to an anchor join it: (cluster_id, id), clusters of one anchor alone too.

    In order of id each anchor that no earlier one took leads, and takes every post that refers to it, whatever its
    place in the order, unless an earlier anchor took it or it leads already.  events(id, is_anchor), edges(source, target).
    """
    from .cluster import leaders

    e = events.select("id", "is_anchor")
    anchors = e.where("is_anchor").select("id")
    refs = edges.where("source <> target").join(anchors.select(F.col("id").alias("target")), "target", "left_semi").join(e.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target").distinct()
    among = refs.join(anchors.select(F.col("id").alias("source")), "source", "left_semi").where("target < source")
    led = leaders(anchors.select("id", F.col("id").alias("ord")), among.select(F.col("target").alias("leader"), F.col("source").alias("follower"), F.lit(1.0).alias("weight")))
    lead = led.where("id = leader").select("id")
    taken = refs.join(lead.select(F.col("id").alias("target")), "target", "left_semi").join(lead.select(F.col("id").alias("source")), "source", "left_anti")
    followers = taken.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("cluster_id"))
    return lead.select(F.col("id").alias("cluster_id"), "id").unionByName(followers.select("cluster_id", "id"))


def cluster_scores(
    members: DataFrame,
    events: DataFrame,
    edges: DataFrame,
    roster: DataFrame,
    weights: DataFrame | None = None,
    least_authors: int = 2,
    coherence: DataFrame | None = None,
    least_coherence: float = 0.0,
    as_of: int | None = None,
) -> DataFrame:
    """members(cluster_id, id) -> per cluster with enough authors: counts, engagement, propagation and event_score.

    weights(cluster_id, cluster_weight) adds half the weight; coherence(cluster_id, coherence) adds itself and drops
    clusters below least_coherence; as_of (seconds) adds a half for clusters whose first post is 24 to 72 hours old.
    """
    from .edges import edges_within

    e = members.join(events, "id").join(roster.select(F.col("username").alias("author"), "followers_count"), "author", "left")
    range_ = [F.min("time").alias("first_ts"), F.max("time").alias("last_ts")] if "time" in events.columns else []
    rows = e.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("tweet_cnt"), F.countDistinct("author").alias("author_cnt"), F.sum("engagement").alias("engagement"), F.sum(F.coalesce("followers_count", F.lit(0))).alias("followers"), *range_
    )
    inner = edges.select(F.col("source").alias("source_tweet_id"), F.col("target").alias("target_tweet_id"))
    rows = rows.join(edges_within(inner, members.select("cluster_id", F.col("id").alias("tweet_id"))), "cluster_id", "left").withColumn("propagation", F.coalesce("propagation", F.lit(0)))
    score = (
        F.log1p("engagement") + 3.0 * F.col("author_cnt") + 1.5 * F.log1p("propagation") + 0.5 * F.log1p("tweet_cnt") + 0.3 * F.log1p(F.col("followers") / F.greatest(F.col("author_cnt"), F.lit(1)))
    )
    if weights is not None:
        rows = rows.join(weights, "cluster_id", "left").withColumn("cluster_weight", F.coalesce("cluster_weight", F.lit(0.0)))
        score = score + 0.5 * F.col("cluster_weight")
    if coherence is not None:
        rows = rows.join(coherence, "cluster_id", "left").withColumn("coherence", F.coalesce("coherence", F.lit(0.0))).where(F.col("coherence") >= least_coherence)
        score = score + F.col("coherence")
    if as_of is not None:
        rows = rows.withColumn("novelty", is_new(F.col("first_ts"), as_of))
        score = score + 0.5 * F.col("novelty")
    return rows.withColumn("event_score", score).where(F.col("author_cnt") >= least_authors)


def is_new(first_ts: Column, as_of: int) -> Column:
    """1 for what began 24 to 72 hours before as_of, else 0."""
    return F.when((as_of - first_ts).between(24 * 3600, 72 * 3600), 1.0).otherwise(0.0)


def pair_coherence(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean similarity of the retained pairs(a, b, cos) within a cluster; a cluster without such a pair has no row."""
    a, b = members.select("cluster_id", F.col("id").alias("a")), members.select("cluster_id", F.col("id").alias("b"))
    return pairs.join(a, "a").join(b, ["cluster_id", "b"]).groupBy("cluster_id").agg(F.avg("cos").alias("coherence"))


def seeded_scores(members: DataFrame, events: DataFrame, propagation: DataFrame, coherence: DataFrame, filtered: bool = True) -> DataFrame:
    """Scores of events from seeds, with novelty log1p(posts) * log1p(authors) and twice the coherence.

    One author costs 0.7 of the score (0.3 below an engagement of 100), a coherence below 0.3 in three posts or more the half;
    filtered drops one author below an engagement of 50 and three posts or more below a coherence of 0.2.
    """
    rows = members.join(events, "id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("tweet_cnt"), F.countDistinct(F.nullif("author", F.lit(""))).alias("author_cnt"), F.sum("engagement").alias("engagement"))
    rows = rows.join(propagation, "cluster_id", "left").join(coherence, "cluster_id", "left").fillna({"propagation": 0, "coherence": 0.0})
    a, t, e, c = F.col("author_cnt"), F.col("tweet_cnt"), F.col("engagement"), F.col("coherence")
    novelty = F.log1p(t) * F.log1p(a)
    score = F.log1p(e) + 3.0 * a + 1.5 * F.log1p("propagation") + 0.5 * novelty + 2.0 * c
    score = score * F.when(a >= 2, 1.0).when(e < 100, 0.3).otherwise(0.7) * F.when((c < 0.3) & (t >= 3), 0.5).otherwise(1.0)
    rows = rows.withColumn("novelty", novelty).withColumn("event_score", score)
    return rows.where(~((a < 2) & (e < 50)) & ~((c < 0.2) & (t >= 3))) if filtered else rows


def top_clusters(scored: DataFrame, score: str = "event_score", n: int = 5) -> DataFrame:
    """The n best with rank, ties by id."""
    from pyspark.sql import Window

    best = scored.orderBy(F.desc(score), "cluster_id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "cluster_id")))  # n rows


def merge_events(members: DataFrame, entities: DataFrame, phrases: DataFrame, most_phrases: int = 10) -> DataFrame:
    """Clusters that share a ticker, a company or two key phrases join the earliest such leader: (cluster_id, id).

    members(cluster_id, id); entities(cluster_id, kind, name); phrases(cluster_id, phrase), of which the first
    `most_phrases` in order count.  Clusters are settled in order of their ids, by their own sets, not merged ones.
    """
    from pyspark.sql import Window

    from ..sources.stages import staged

    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("phrase"))
    key = phrases.distinct().withColumn("p", place).where(F.col("p") <= most_phrases).select("cluster_id", F.concat(F.lit("phrase:"), "phrase").alias("k"), F.lit(1).alias("w"))
    names = entities.where(F.col("kind").isin("tickers", "companies")).select("cluster_id", F.concat_ws(":", "kind", "name").alias("k"), F.lit(2).alias("w"))
    keys = staged(key.unionByName(names).distinct(), "merge-keys")
    ids = members.select(F.col("cluster_id").alias("id")).distinct()

    def meet(leaders: DataFrame, clusters: DataFrame) -> DataFrame:
        a = keys.join(leaders.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select(F.col("cluster_id").alias("a"), "k", "w")
        b = keys.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").select(F.col("cluster_id").alias("b"), "k")
        met = shared_key_pairs(a.select("a", "k"), b)
        w = met.join(a, "a").join(b, ["b", "k"]).groupBy("a", "b").agg(F.sum("w").alias("w"))
        return w.where("w >= 2").select("a", "b", F.lit(1.0).alias("weight"))

    found = block_leaders(ids, meet)
    return members.join(found.select(F.col("id").alias("cluster_id"), "leader"), "cluster_id").select(F.col("leader").alias("cluster_id"), "id").distinct()
