import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import sharding
from corpusloom.llm.sharding import layout, shard, shard_of


def test_law_slots_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 8)
    rows = [(i, f"text é {i}") for i in range(3_000)] + [(7, "text é 7"), (7, None), (None, "x"), (None, None), (9_999, ""), (10_000, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, shard string, slot int").repartition(4)
    got = shard(df).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by_key = {}
    for r in got:
        assert r.grown_shard in (r.shard, 24)
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) < 2 * min(counts.values())
    assert 60 < sum(r.grown_shard == 24 for r in got) < 200
    assert shard(df.limit(0)).count() == 0


def test_changed_weights_move_rows_only_through_their_subtrees(spark):
    base = layout(24)
    heavier = [(r, k, s, 3.0 if s == 5 else w) for r, k, s, w in base]
    moved = spark.range(4_000).select(shard_of(F.col("id"), base).alias("a"), shard_of(F.col("id"), heavier).alias("b")).where("a != b").collect()
    rack = {s: k for _, k, s, _ in base}
    region = {s: r for r, _, s, _ in base}
    assert moved
    for r in moved:
        assert r.b == 5 or rack[r.b] == rack[5] and rack[r.a] != rack[5] or region[r.b] == region[5] and region[r.a] != region[5]
    without = [(r, k, s, 0.0 if s == 5 else w) for r, k, s, w in base]
    assert spark.range(2_000).select(shard_of(F.col("id"), without).alias("b")).where("b = 5").count() == 0


def descend(key, leaves):
    """The shard of a key, level by level, with the draws of one node's children at a time."""
    tree = {}
    for region, rack, number, weight in leaves:
        path = ["", region, f"{region}/{rack}", f"{region}/{rack}/{number}"]
        for node, child in zip(path, path[1:]):
            tree.setdefault(node, {}).setdefault(child, 0.0)
            tree[node][child] += weight
    at = ""
    while at in tree:

        def draw(child, at=at):
            u = (int(hashlib.md5(f"{child}\n{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return math.log(u) / tree[at][child]

        at = max((c for c in tree[at] if tree[at][c] > 0), key=draw)
    return int(at.rsplit("/", 1)[1])


def test_shards_are_those_of_a_plain_descent_and_shares_follow_weights(spark):
    leaves = [(r, k, s, 1.0 + s % 3) for r, k, s, _ in layout(25)]
    got = spark.range(-10, 6_000).select("id", shard_of(F.col("id"), leaves).alias("s")).collect()
    assert all(r.s == descend(r.id, leaves) for r in got)
    counts, total = Counter(r.s for r in got), sum(w for *_, w in leaves)
    for _, _, s, w in leaves:
        want = len(got) * w / total
        assert abs(counts[s] - want) < 5 * want**0.5


def test_alike_rows_are_dealt_out_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 16)
    df = spark.range(5_000).selectExpr("if(id < 3000, 7, id) doc_id", "'same' text")
    rows = shard(df)
    got = rows.collect()
    assert len(got) == 5_000 and Counter(r.doc_id for r in got)[7] == 3_000
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(rows.rdd.glom().map(len).collect()) < 3_000
