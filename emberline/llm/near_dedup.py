"""MinHash near-dedup: banded candidates, odd sketches, exact confirmation.

1. Each text's distinct word shingles give MinHash values; bands of them give bucket keys, and all of
   them are folded into a parity bitmap (odd sketch).  Texts with equal sets share one representative.
2. Members of a bucket are paired with the bucket's smallest member only.  The XOR population count of
   two sketches estimates the similarity; a text's most similar leader is confirmed on full sets.
3. Confirmed links make components.  Components that still meet in a bucket form a family, which is
   searched exactly: members outside the family's largest component meet all members of other
   components, in tiles of bounded size that hold their whole sets; sketches rule out most pairs and
   order the rest.  A tile returns links, at most one per member.  Pairs inside one component need no
   test, so a group of copies costs a row per member and band, never a row per pair.

A pair at the threshold shares a band with probability 1 - (1 - 0.8^4)^27 > 1 - 10^-6.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, mix, mix_int, ship, slices, written
from .graph import connected_components

BANDS, ROWS = 27, 4
SKETCH_WORDS = 4
#: Members on each side of a tile, about.
TILE = 400
#: Ids of candidate documents that are broadcast to filter the texts; beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000

_K = BANDS * ROWS
_MUL = np.array([mix_int(i) | 1 for i in range(_K)], dtype=np.uint64).astype(np.uint32)
_XOR = np.array([mix_int(i + 1_000_003) for i in range(_K)], dtype=np.uint64).astype(np.uint32)


def shingle_sets(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first index by text); fewer words make one shingle."""
    first, parts = [0], []
    n = len(w.hash)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(shingle):
        if n - j > 0:
            rolled[: n - j] = mix(rolled[: n - j] ^ w.hash[j:])
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        if hi - lo >= shingle:
            part = np.unique(rolled[lo : hi - shingle + 1])
        elif hi > lo:
            one = np.zeros(1, dtype=np.uint64)
            for i in range(lo, hi):
                one = mix(one ^ w.hash[i : i + 1])
            part = mix(one + np.uint64(hi - lo))
        else:
            part = w.hash[:0]
        parts.append(part)
        first.append(first[-1] + len(part))
    return np.concatenate(parts) if parts else w.hash[:0], np.array(first)


def _sketches(sets: np.ndarray, first: np.ndarray):
    """By text with a set: bands (n, BANDS) and odd sketch (n, SKETCH_WORDS), both uint64, and digests."""
    start = first[:-1]
    x = (sets >> np.uint64(32)).astype(np.uint32)
    n = len(start)
    bands = np.empty((n, BANDS), dtype=np.uint64)
    sketch = np.zeros((n, SKETCH_WORDS), dtype=np.uint64)
    rows = np.arange(n)
    for b in range(BANDS):
        key = np.full(n, mix_int(b), dtype=np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            low = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], start).astype(np.uint64)
            key = mix(key ^ low)
            at = mix(low + (np.uint64(i) << np.uint64(32)))
            word = ((at >> np.uint64(8)) % np.uint64(SKETCH_WORDS)).astype(np.int64)
            sketch[rows, word] ^= np.uint64(1) << (at & np.uint64(63))
        bands[:, b] = key
    d1 = np.add.reduceat(mix(sets), start)
    d2 = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), start)
    return bands, sketch, d1, d2


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    ship(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                sets, first = shingle_sets(Words(data, offsets, NOT_SPACE), shingle)
                sizes = np.diff(first)
                full = np.flatnonzero(sizes)
                n = hi - lo
                some = np.zeros(n, dtype=bool)
                some[full] = True
                d1, d2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                bands = np.zeros((n, BANDS), dtype=np.uint64)
                sketch = np.zeros((n, SKETCH_WORDS), dtype=np.uint64)
                if len(full):
                    bands[full], sketch[full], d1[full], d2[full] = _sketches(sets, np.append(first[full], first[-1]))

                def lists(m):
                    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.view(np.int64).ravel()))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(sizes, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(bands), lists(sketch)],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>")


def _far(threshold: float) -> int:
    """Most differing sketch bits at which a pair at the threshold is still confirmed (six deviations)."""
    low = max(0.0, threshold - 6 * math.sqrt(threshold * (1 - threshold) / _K))
    bits = 64 * SKETCH_WORDS
    expected = bits / 2 * (1 - math.exp(-4 * _K * (1 - low) / bits))
    return min(bits, int(expected + 2 * math.sqrt(expected)))


def _similar(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b) whose sizes and sketches allow the threshold, with differing sketch bits as far."""
    side = lambda x: sigs.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    far: Column = sum((F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    out = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * small >= F.lit(round(threshold * 100)) * large)
    return out.select("a", "b", far.alias("far")).where(F.col("far") <= _far(threshold))


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs(a, b) whose whole sets reach the threshold."""
    percent = round(threshold * 100)
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "candidates")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    joined = (
        pairs.select("a", "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    )

    def test(batches):
        for batch in batches:
            lefts = ((s, f) for _, _, d, o in slices(batch.column(2), 1 << 20) for s, f in [shingle_sets(Words(d, o, NOT_SPACE), shingle)])
            rights = ((s, f) for _, _, d, o in slices(batch.column(3), 1 << 20) for s, f in [shingle_sets(Words(d, o, NOT_SPACE), shingle)])
            one = lambda it: (s[f[i] : f[i + 1]] for s, f in it for i in range(len(f) - 1))
            ok = []
            for x, y in zip(one(lefts), one(rights)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(len(x) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return joined.mapInArrow(test, f"a {kind}, b {kind}").distinct()


def _family_links(members: DataFrame, docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """members(doc_id, component, family) -> links (a, b) between components of a family."""
    percent, far = round(threshold * 100), _far(threshold)
    kind = dict(members.dtypes)["doc_id"]
    few = members.count() <= BROADCAST_IDS
    ids = members.select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def scan(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                sets, first = shingle_sets(Words(data, offsets, NOT_SPACE), shingle)
                full = np.flatnonzero(np.diff(first))
                if len(full):
                    sketch = _sketches(sets, np.append(first[full], first[-1]))[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo).take(pa.array(full)),
                            pa.array([sets[first[i] : first[i + 1]].tobytes() for i in full], pa.binary()),
                            pa.array([x.tobytes() for x in sketch], pa.binary()),
                        ],
                        names=["doc_id", "members", "sketch"],
                    )

    sets = texts.mapInArrow(scan, f"doc_id {kind}, members binary, sketch binary").join(members, "doc_id")
    sizes = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("family").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("top"))
    sizes = sizes.select("family", F.col("top.component").alias("top"), F.col("size"), (F.col("size") - F.col("top.n")).alias("minors"))
    small = F.col("size") <= TILE
    packs = max(1, -(-int(sizes.where(small).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // TILE))
    across = F.greatest(F.lit(1), F.ceil(F.col("size") / TILE)).cast("int")
    down = F.greatest(F.lit(1), F.ceil(F.col("minors") / TILE)).cast("int")
    sizes = sizes.select(
        "family",
        "top",
        F.when(small, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.xxhash64("family")).alias("pack"),
        F.when(small, 1).otherwise(across).alias("across"),
        F.when(small, 1).otherwise(down).alias("down"),
    )
    sets = written(sets.join(sizes, "family"), "sets")
    last = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["doc_id", "component", "family", "members", "sketch", "pack"]
    left = sets.where("component <> top").select(*columns, F.pmod(F.xxhash64("doc_id"), "down").cast("int").alias("i"), last("across").alias("j"))
    right = sets.select(*columns, last("down").alias("i"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "across").cast("int").alias("j"))

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            sa, sb = (np.frombuffer(b"".join(x["sketch"]), dtype=np.uint64).reshape(len(x), SKETCH_WORDS) for x in (a, b))
            na, nb = (x["members"].str.len().to_numpy() // 8 for x in (a, b))
            fa, fb, ca, cb = a["family"].to_numpy(), b["family"].to_numpy(), a["component"].tolist(), b["component"].tolist()
            parent: dict = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            pairs = []
            for i in range(len(a)):
                bits = np.bitwise_count(sb ^ sa[i]).sum(axis=1)
                ok = (bits <= far) & (fb == fa[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i]))
                j = np.flatnonzero(ok)
                pairs.append(np.stack([bits[j].astype(np.int64), np.full(len(j), i), j], axis=1))
            pairs = np.concatenate(pairs)
            va, vb = ([np.frombuffer(m, dtype=np.uint64) for m in x["members"]] for x in (a, b))
            ia, ib = a["doc_id"].tolist(), b["doc_id"].tolist()
            for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                x, y = root(ca[i]), root(cb[j])
                if x != y:
                    at = np.searchsorted(vb[j], va[i])
                    at[at == len(vb[j])] = 0
                    both = int((vb[j][at] == va[i]).sum())
                    if 100 * both >= percent * (len(va[i]) + len(vb[j]) - both):
                        parent[max(x, y)] = min(x, y)
                        out.append((ia[i], ib[j]))
        return pd.DataFrame(out, columns=["a", "b"]) if out else pd.DataFrame({"a": [], "b": []}).astype("int64" if kind in ("bigint", "int") else "object")

    keys = ["pack", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> per row doc_id, n_shingles, component_id (smallest doc_id linked), kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Null and wordless texts have
    an empty set and stay alone.  Rows of one doc_id are one node, linked by any of their texts.  A
    row with a null doc_id is judged by nothing: component_id null, kept true.  An empty table gives
    an empty table.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sigs = written(signatures(docs, shingle), "signatures")
    real = sigs.where("doc_id is not null and n_shingles > 0")
    classes = written(real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    # rows of one id with different texts, and representatives of their classes
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2", "n_shingles"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi")
    reps = reps.dropDuplicates(["doc_id", "d1", "d2"])
    links = real.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")

    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last")
    members = written(banded.join(leaders.select("bucket", "leader"), "bucket").select("bucket", "doc_id", "leader"), "buckets")
    stars = members.where("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = _similar(stars.select("a", "b"), reps, threshold)
    best = stars.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    tested = written(best, "pairs")
    edges = written(_confirmed(tested, docs, shingle, threshold), "links")

    comps = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = members.select("bucket", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = written(named.groupBy("bucket", "component").agg(F.min("doc_id").alias("one")), "spans")
    meet = sizes.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket", "low")
    meet = written(sizes.join(meet, "bucket").where("component <> low").select(F.col("component").alias("u"), F.col("low").alias("v")).distinct(), "meetings")
    if not meet.isEmpty():
        families = connected_components(meet).select(F.col("node").alias("component"), F.col("component").alias("family"))
        found = _family_links(written(named.select("doc_id", "component").distinct().join(families, "component"), "families"), docs, shingle, threshold)
        edges = edges.unionByName(written(found, "links"))
    # ids that share a class join the texts' links; with one text per id this adds only stars
    several = sigs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    graph = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if several.isEmpty():
        comps = connected_components(graph)
        found = sigs.join(classes, ["d1", "d2", "n_shingles"], "left").join(comps, F.col("rep") == F.col("node"), "left")
        component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    else:
        comps = connected_components(graph.unionByName(links))
        found = sigs.join(comps, F.col("doc_id") == F.col("node"), "left")
        component = F.coalesce("component", "doc_id")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows whose id isn't the smallest of its component; columns stay as they are."""
    gone = near_duplicates(docs, shingle, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def sql(shingle: int = 2) -> str:
    return f"""
WITH RECURSIVE doc AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + {shingle - 1}], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {shingle - 2}))) AS i FROM doc WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM doc d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""
