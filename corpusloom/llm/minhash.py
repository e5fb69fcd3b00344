"""Near-duplicates by fast similarity sketches, banding and exact verification.

A document is its set of distinct five-word shingles. Its sketch of T coordinates is filled in rounds: in each
round every shingle is thrown into one hashed bin with a hashed value, the smallest stays, and a
document leaves when all bins are full; from round T on, round T + i fills bin i
for certain. Documents of one set are one node from the start. Nodes that share a band of
coordinates are candidates; bands and their rows follow from the threshold, so that a pair at it escapes all bands with probability MISS at most.

Within a bucket no pairs are listed: all members are verified against the most central
one. Members that then still lie in different components are joined on prefixes of the shingles in which they differ from the
central member: two that are linked, but not both with it, differ from it in much the same way. There too each meets one other first, and only
what still lies apart meets all. So every pair that shares a band is
linked, known to be no link, or inside one component, while the pairs of a group are never listed. Links are confirmed on full sets.

Defined results: a document without words is linked with nothing and kept; fewer
than five words are one shingle; very long texts are sketched and compared whole; repeated rows and equal sets are one node; a
null doc_id takes part but never names a component, unless there is no other; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.tables import in_batches, read, stored
from corpusloom.llm.words import U64, Words, grams, mix, signed, texts_of

SHINGLE = 5
THRESHOLD = 85  # per cent of the union, in op6
MISS = 3e-6
MOST = 168  # coordinates of a sketch, unless bands of one row need more
_EMPTY = U64((1 << 64) - 1)


def banding(threshold: int) -> tuple[int, int]:
    """Bands, and rows of each: the most rows with which MOST coordinates let a pair at the threshold (per cent) escape with probability MISS at most."""
    if not 0 < threshold <= 100:
        raise ValueError(f"a threshold of {threshold} per cent is not above 0 and at most 100")
    if threshold == 100:
        return 1, MOST
    bands = lambda rows: math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** rows)))
    rows = 1
    while bands(rows + 1) * (rows + 1) <= MOST:
        rows += 1
    return bands(rows), rows


def shingle_sets(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    whole = w.grams(k)
    short = {n: grams(w.hash, n, 100 + n) for n in range(1, k)}
    out = []
    for first, n in zip(w.first[:-1], w.counts):
        out.append(np.unique(whole[first : first + n - k + 1]) if n >= k else short[n][first : first + 1] if n else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each set; those of an empty set stay empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), t), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    items, owner = (np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items, i + 1)
        bins = ((h >> U64(40)) % U64(t)).astype(np.int64) if i < t else np.full(len(items), i - t)
        np.minimum.at(flat, owner * t + bins, U64(i << 48) | h & U64((1 << 40) - 1))
        stay = np.zeros(len(sets), bool)
        stay[owner] = True
        stay[stay] = (out[stay] == _EMPTY).any(1)
        keep = stay[owner]
        items, owner = items[keep], owner[keep]
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of each sketch; other bands never share a hash but by chance."""
    rows = sketch.shape[1] // bands
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        h = mix(h * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return mix(h + np.arange(bands, dtype=np.uint64))


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.bitwise_xor.reduce(mix(s, 501), keepdims=True) + mix(np.sum(mix(s, 502), keepdims=True)) + U64(len(s)))[0].view(np.int64)) if len(s) else 0


def set_twin(s: np.ndarray) -> int:
    """Another hash of the set, by which sets of one hash are told apart."""
    return int(mix(np.bitwise_xor.reduce(mix(s, 503), keepdims=True) * U64(3) + mix(np.sum(mix(s, 504), keepdims=True), 9))[0].view(np.int64)) if len(s) else 0


def signatures(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, node and twin (hashes of the set, node null if it is empty), bands."""
    n, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in texts_of(batches, "text", fold=True):
            sets = shingle_sets(w)
            bands = signed(band_hashes(sketches(sets, n * rows), n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(list(map(set_twin, sets)), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(bands.reshape(-1))),
                ],
                ["doc_id", "key", "n_shingles", "node", "twin", "bands"],
            )

    return in_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), run, "doc_id long, key long, n_shingles long, node long, twin long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """node, twin, items (the packed sorted set) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in texts_of(batches, "text", fold=True):
            sets = [s for s in shingle_sets(w) if len(s)]
            hashes = (pa.array([f(s) for s in sets], pa.int64()) for f in (set_hash, set_twin))
            yield pa.RecordBatch.from_arrays([*hashes, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "twin", "items"])

    return in_batches(docs.select("text"), run, "node long, twin long, items binary")


def _apart(df: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """df with another node for the sets that clash: different ones of one hash."""
    if clashes is None:
        return df
    joined = df.join(clashes.select("node", F.lit(True).alias("clash")), "node", "left")
    return joined.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "twin")).otherwise(F.col("node"))).select(df.columns)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            good = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= threshold * (len(p) + len(q) - shared))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])

    one = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    two = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    return in_batches(pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y"), run, "a long, b long")


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys whose nodes lie in several components, with the largest one as most (k, component)."""
    parts = rows.groupBy(key, "component").agg(F.count("*").alias("k"))
    mixed = parts.groupBy(key).agg(F.count("*").alias("parts"), F.max(F.struct("k", "component")).alias("most")).where("parts > 1")
    return rows.join(mixed.select(key, "most"), key)


def differences(x: np.ndarray, y: np.ndarray, threshold: int) -> tuple[np.ndarray, int, int, bool]:
    """The shingles that a set x and a central set y don't share; how many of them, in an order that holds for all sets, are to meet sets that link to y, and how many others; whether x links to y.

    Call these shingles D(x), d of them. Two sets link if at most b = (100 - t) / (100 + t) of both sizes is in one of them alone, and what is in one of
    them alone is what is in D of one alone; so they link if their D share (d(x) + d(z) - b (|x| + |z|)) / 2 or more. A set that doesn't
    link to y has d(z) > b (|z| + |y|), so to meet one, more than (d(x) + b (|y| - |x|)) / 2 of D(x) must be shared. To meet
    one that links to y, a set that doesn't must share d(x) - |x| (100 - t) / t at least. Where so many must be shared, all but so many and one more hold the first shared one.
    """
    some = np.setxor1d(x, y, assume_unique=True)
    d, n = len(some), len(x)
    shared = (n + len(y) - d) // 2
    linked = 100 * shared >= threshold * (n + len(y) - shared)
    apart = max(0, ((100 + threshold) * d + (100 - threshold) * (len(y) - n)) // (2 * (100 + threshold))) + 1
    near = max(1, d - n * (100 - threshold) // threshold)
    return some, 0 if linked else max(0, d - near + 1), max(0, d - apart + 1), linked


_DIFFERING = "key long, a long, node long, n long, component long, d long, near long, apart long, linked boolean"


def _differing(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """node, n, component, and whether it links to a central member a; key: the hash of a, of a shingle of the node's differences from it, and of which sets it is to meet there; d, how many differences; left, how many from this one on.

    The rarest differences come first, so that one that a whole family shows hardly ever leads to a meeting, and those of one node alone to none. Of two
    sets that link to a both are in one component, so sets that link to it only meet others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, node, n, component = (batch.column(k)[i].as_py() for k in range(4))
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                some, near, apart, linked = differences(x, y, threshold)
                keys = signed(mix(some + mix(np.array([a], np.int64).view(np.uint64))))
                same = [pa.array(np.full(len(keys), v)) for v in (a, node, n, component, len(keys), near, apart, linked)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *same], ["key", "a", "node", "n", "component", "d", "near", "apart", "linked"])

    of = rows.select("a", "node", "n", "component").distinct()
    one = sets.select("node", F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("a"), F.col("items").alias("y"))
    every = stored(in_batches(of.join(one, "node").join(two, "a").select("a", "node", "n", "component", "x", "y"), run, _DIFFERING), "differing")
    times = every.groupBy("key").agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy("a", "node").orderBy("times", "key"))
    ranked = every.join(times, "key").withColumn("rank", rank).where("times > 1")
    # a linked set meets those apart, at the keys by which these meet linked ones
    meets = F.array_compact(F.array(F.when(F.col("rank") <= F.when(F.col("linked"), F.col("apart")).otherwise(F.col("near")), True), F.when(~F.col("linked") & (F.col("rank") <= F.col("apart")), False)))
    ranked = ranked.withColumn("meets_linked", F.explode(meets)).withColumn("left", F.col("d") - F.col("rank") + 1)
    return ranked.select(F.xxhash64("key", "meets_linked").alias("key"), "node", "n", "component", "d", "left", "linked", "meets_linked")


def _meetings(differing: DataFrame, threshold: int, first: bool) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may link: at each key all, or only each one with the first, the closest to the central member."""
    close = (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * threshold) & (F.col("component") != F.col("component_a"))
    # two that link share (d + d_a - b (n + n_a)) / 2 differences at least; from their first common one on, both must have so many
    shared = (100 + threshold) * (F.col("d") + F.col("d_a")) - (100 - threshold) * (F.col("n") + F.col("n_a"))
    enough = F.least("left", "left_a") * (2 * (100 + threshold)) >= shared
    named = {c: f"{c}_a" for c in ("n", "component", "d", "left")} | {"node": "a"}
    loose = differing.where("not linked")
    if first:
        order = F.struct("d", "node", "n", "component", "left")
        hosts = differing.where("linked or not meets_linked").groupBy("key").agg(F.min(order).alias("host")).select("key", "host.*")
        guests = loose
    else:
        hosts = differing.where("linked").select("key", "node", "n", "component", "d", "left")
        apart = _open(loose.where("not meets_linked"), "key")
        hosts = hosts.union(apart.where("component != most.component").select(hosts.columns))
        guests = loose
    pairs = guests.join(hosts.withColumnsRenamed(named), "key").where(close & enough)
    return pairs.select(F.greatest("a", "node").alias("a"), F.least("a", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, group (null if empty), component_id (its smallest doc_id), kept for each row of docs."""
    close = (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * threshold) & (F.col("node") != F.col("a"))
    signed_docs, clashes = stored(signatures(docs, threshold), "signatures"), None
    while True:
        twins = (F.min("twin").alias("twin"), F.max("twin").alias("last_twin"))
        nodes = signed_docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), *twins)
        nodes = stored(nodes, "nodes")
        found = nodes.where("twin != last_twin")
        if clashes is not None or not found.take(1):
            break
        clashes = stored(found.select("node"), "clashes")
        signed_docs = stored(_apart(signed_docs, clashes), "signatures")
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(rows.join(shared, "bucket"), "members")

    # the most central member: the one that meets most others, over all its buckets
    weight = members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("weight"))
    leaders = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    leaders = leaders.select("bucket", F.col("top.node").alias("a"), F.col("top.n").alias("n_a"))
    stars = stored(members.join(leaders, "bucket").where(close).select("a", F.col("node").alias("b")).distinct(), "pairs")

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    nameless = docs.where("doc_id is null").select("doc_id", "text")
    sets = stored(_apart(_sets(texts.union(nameless)), clashes).drop("twin").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    links = stored(_confirmed(stars, sets, threshold), "links")
    labels = components(links)
    tested = stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    placed = stored(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    differing = stored(_differing(_open(placed, "bucket").join(leaders, "bucket"), sets, threshold), "differing")
    # what may link meets one at each key first; who still lies apart then meets all
    for first in (True, False):
        rest = stored(_meetings(differing, threshold, first).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = stored(_confirmed(rest, sets, threshold), "links")
        if more.take(1):
            links = links.union(more)
            labels = components(links)
            if first:
                component = labels.withColumnRenamed("component", "now")
                differing = differing.join(component, "node", "left").withColumn("component", F.coalesce("now", "component")).drop("now")
        tested = tested.union(rest.select("a", "b"))

    # names are found among nodes, not among rows: a text with many copies is one node, and one without a link names itself
    named = nodes.select("node", "doc_id").join(labels, "node", "left")
    names = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name"))
    linked = named.where("component is not null").join(names, "component").select(F.col("node").alias("of"), F.col("component").alias("group"), "name")
    alone = named.where("component is null").select(F.col("node").alias("of"), F.col("node").alias("group"), F.col("doc_id").alias("name"))
    return signed_docs.drop("bands", "twin").join(linked.union(alone), F.col("node") == F.col("of"), "left").select(
        "doc_id",
        "key",
        "n_shingles",
        "group",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
        F.when(F.col("group").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("name"))).alias("kept"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
