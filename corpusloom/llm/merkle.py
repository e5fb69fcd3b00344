"""A Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

Trees grow in supersteps over RDDs of vertices. Upward, each child sends its digest to its parent, which is
its own place divided by FAN; a parent that has heard all of its children hashes them and is a child of the
next superstep. Each level's runs of siblings are stored in the shared folder, so a lost executor costs one level at most.
Downward, a vertex sends each child the siblings on the child's way to the root, level by level, until the
leaves can fold their own digests and compare what comes out with the root.

Places come from a range exchange: rows are sorted by tree and order in partitions of even size, numbered there, and
the counts of earlier partitions are added; so a source of a third of all rows is spread like any other, and no
task or driver holds a tree. A message holds the siblings of one run, never more than FAN digests a level.

Defined results: a null field is ``-``, an empty one ``0:``; rows without doc_id come first in their source and are never tampered with; rows of one
doc_id follow their leaves' digests, and alike rows are leaves of their own; the null source is a source, the first; an empty
table gives no rows; very long texts are hashed where they are read and go no further; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import ascii_lower, in_batches, partitions, read, stored, written

#: Children of a vertex.
FAN = 16
#: Of how many doc_ids, by CRC-32, one row is tampered with.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
__all__ = ["fold", "leaf", "manifest", "numbered", "op11_merkle", "written"]
#: A run of siblings: its tree, its parent's place, how many vertices the tree has on this level, the digests and what belongs to them.
RUNS = "tree string, run long, size long, digests array<string>, rest array<struct<name: string, id: long, changed: string, level: int>>"


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, each with its length."""

    def field(name: str) -> Column:
        text = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes with at (the place in its tree, from 0) and size (of the tree); order with tree tells all rows apart."""
    spark = nodes.sparkSession
    sorted_ = nodes.repartitionByRange(partitions(spark), "tree", *order).sortWithinPartitions("tree", *order)
    names = nodes.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column(names.index("tree")).to_pylist():
                now, n = tree, n + 1 if tree == now else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], [*names, "part", "place"])

    fields = ", ".join(f"{n} {t}" for n, t in nodes.dtypes)
    placed = stored(in_batches(sorted_, number, f"{fields}, part int, place long"), "places")
    counts = placed.groupBy("tree", "part").agg((F.max("place") + 1).alias("n"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"))
    return placed.join(counts, ["tree", "part"]).select(*names, (F.col("before") + F.col("place")).alias("at"), "size")


def _place(key: tuple[str, int]) -> int:
    return zlib.crc32(f"{key[1]}/{key[0]}".encode())


def superstep(children: RDD, parts: int) -> RDD:
    """children (tree, at, size, digest, rest) send themselves to their parents; a row of RUNS for each parent that has heard of all."""

    def hear(vertex):
        (tree, run), heard = vertex
        heard = sorted(heard, key=lambda m: m[0])
        size = heard[0][1]
        if len(heard) != min(FAN, size - run * FAN):
            raise ValueError(f"{tree!r}: run {run} has {len(heard)} vertices")
        return tree, run, size, [m[2] for m in heard], [m[3] for m in heard]

    messages = children.map(lambda c: ((c[0], c[1] // FAN), (c[1] % FAN, c[2], c[3], c[4])))
    return messages.groupByKey(parts, _place).map(hear)


def grow(spark: SparkSession, nodes: DataFrame, *order: str) -> list[DataFrame]:
    """The runs of every level, leaves first; nodes has tree, digest and name, id, changed, level, which go with a leaf."""
    placed = numbered(nodes, *order)
    children = placed.select("tree", "at", "size", "digest", F.struct("name", "id", "changed", "level")).rdd.map(tuple)
    levels: list[DataFrame] = []
    most, parts = 1, partitions(spark)
    while not levels or most > 1:
        level = stored(spark.createDataFrame(superstep(children, parts), RUNS, verifySchema=False), "runs")
        if not levels:
            most = level.agg(F.max("size")).first()[0] or 1
        levels.append(level)
        most, parts = -(-most // FAN), max(1, parts // FAN)
        # a tree whose vertices are one run ends with its hash; all others go on
        children = level.where(f"size > {FAN}").select("tree", "run", "size", "digests").rdd.map(lambda r: (r[0], r[1], -(-r[2] // FAN), _hash(*r[3]), None))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest and level (of its last run) of each tree; a lone leaf is the root itself."""
    digest = F.when(F.col("size") == 1, F.col("digests")[0]).otherwise(F.sha2(F.concat_ws("", "digests"), 256)).alias("digest")
    tops = [x.where(f"size <= {FAN}").select("tree", digest, F.lit(n).alias("level")) for n, x in enumerate(levels)]
    return reduce(DataFrame.union, tops)


def descend(levels: list[DataFrame], above: RDD, parts: int) -> RDD:
    """The runs of leaves, each with what above says of its tree and the siblings between its parent and the root of all.

    above: (tree, (level, info, steps)). Gives (run, (info, steps)); steps are pairs: digests to the left, to the right.
    """
    vertices = None
    for n in reversed(range(len(levels))):
        width = max(1, parts // FAN**n)
        tops = above.filter(lambda a, n=n: a[1][0] == n).map(lambda a: ((a[0], 0), a[1][1:]))
        parents = tops if vertices is None else tops.union(vertices)
        runs = levels[n].rdd.map(lambda r: ((r[0], r[1]), tuple(r)))
        met = runs.join(parents, width).values()
        vertices = met.flatMap(lambda x: [((x[0][0], x[0][1] * FAN + i), (x[1][0], [step, *x[1][1]])) for i, step in enumerate(siblings(x[0]))])
    return met


def siblings(run: tuple) -> list[tuple[str, str]]:
    """What stands to the left and to the right of each vertex of a run."""
    digests = run[3]
    return [("".join(digests[:i]), "".join(digests[i + 1 :])) for i in range(len(digests))]


def steps_of(run: tuple, steps: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """The way of each vertex of a run to the root; a lone one has none below its tree's root."""
    for step in siblings(run):
        yield steps if run[2] == 1 else [step, *steps]


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = _hash(left, digest, right)
    return digest


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs."""
    spark = docs.sparkSession
    parts = partitions(spark)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    rows = docs.select(
        # the null source before all others
        F.coalesce(F.concat(F.lit("."), F.col("source")), F.lit("")).alias("tree"),
        leaf().alias("digest"),
        F.lit(None).cast("string").alias("name"),
        F.col("doc_id").cast("long").alias("id"),
        F.when(tampered, leaf(text=ascii_lower(F.col("text")))).alias("changed"),
        F.lit(None).cast("int").alias("level"),
        F.monotonically_increasing_id().alias("row"),
    )
    # stored before they are sampled and dealt out: texts are hashed once, and a row keeps its number
    leaves = grow(spark, stored(rows, "leaves"), "id", "digest", "row")
    tops = stored(roots(leaves), "roots")
    sources = tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("changed"), "level")
    trunk = grow(spark, sources, "name")
    root = roots(trunk).rdd.map(lambda r: (r[0], (r[2], r[1], [])))

    def to_sources(met):
        run, (root_digest, steps) = met
        for (name, _, _, level), digest, way in zip(run[4], run[3], steps_of(run, steps)):
            yield name, (level, (digest, root_digest), way)

    def to_rows(met):
        run, ((subroot, root_digest), steps) = met
        for (_, doc_id, changed, _), digest, way in zip(run[4], run[3], steps_of(run, steps)):
            folded = fold(changed or digest, way)
            yield doc_id, digest, subroot, root_digest, _hash(*(x for step in way for x in step)), folded, folded == root_digest

    ways = descend(trunk, root, max(1, parts // FAN)).flatMap(to_sources)
    found = descend(leaves, ways, parts).flatMap(to_rows)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(found, schema, verifySchema=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))
