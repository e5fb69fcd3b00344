"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws ``ln(u) / weight`` for every child of the node that
it stands on, u being a hash of its key and of the child's name, and descends to the
child with the largest draw. A child is then chosen in proportion to its weight,
and a changed weight moves rows only into or out of the subtrees that hold it.

Shards beyond the base layout arrive as regions of their own, so that one more
shard gives no other node another weight: it takes rows only into itself.

Slots number the rows of a shard from 0 without gaps. Rows that are alike are counted before
they meet, and no task sorts a whole shard: groups of alike rows are numbered inside hashed
blocks of a shard, and the counts of earlier blocks are added, so that the blocks grow in number and not in size. Many
alike rows are dealt out again in pieces of PIECE slots.

Defined results: a null text has size 8 and the CRC-32 of nothing, 0; a null doc_id
is a key of its own; very long texts are measured where they are read; repeated rows share the shard and have slots of their own, next to each other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import partitions, read

SHARDS = 24
BASE_SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 24, 3, 4
#: Rows of a block, about.
BLOCK_ROWS = 4_096
#: Slots of alike rows that one row of the plan stands for at most.
PIECE = 4_096

#: (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


def layout(shards: int) -> list[Leaf]:
    """Racks of 4 and regions of 3 racks up to the base; each further shard is a region of its own."""
    leaves: list[Leaf] = []
    for s in range(shards):
        if s < BASE_SHARDS:
            rack = s // SHARDS_PER_RACK
            leaves.append((f"region{rack // RACKS_PER_REGION}", f"rack{rack}", s, 1.0))
        else:
            leaves.append((f"region+{s}", f"rack+{s}", s, 1.0))
    return leaves


def _bits(*parts: Column) -> Column:
    """52 bits of the MD5 of some strings."""
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13), 16, 10).cast("long")


def _descend(key: Column, children: Column) -> Column:
    """The name of the child with the largest draw, ln(u) / weight; u has 52 bits of a hash and is never 0."""

    def draw(child: Column) -> Column:
        bits = _bits(child["name"], key).cast("double")
        return F.struct((F.ln((bits + 0.5) / F.lit(float(1 << 52))) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_max(F.transform(children, draw))["name"]


def shard_of(key: Column, leaves: Iterable[Leaf]) -> Column:
    """The shard that a key descends to; nodes without weight get no keys."""
    leaves = [x for x in leaves if x[3] > 0]
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]  # of each level: node, its children, their weights
    for region, rack, shard, weight in leaves:
        path = ["", region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        for level, (node, child) in zip(levels, zip(path, path[1:])):
            below = level.setdefault(node, {})
            below[child] = below.get(child, 0.0) + weight
    at: Column = F.lit("")
    for level in levels:
        nodes = F.create_map(*(x for node, below in level.items() for x in (F.lit(node), F.array(*(F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight")) for name, weight in below.items())))))
        at = _descend(key, nodes[at])
    return F.substring_index(at, "/", -1).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "key") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    if law != "key":
        raise ValueError("this tree places rows by key")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), layout(shards)).alias("shard"),
        shard_of(F.col("doc_id"), layout(shards + 1)).alias("grown_shard"),
    )
    blocks = max(1, math.ceil(docs.count() / (BLOCK_ROWS * shards)))
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    alike = alike.withColumn("block", (_bits(F.lit("block"), F.col("doc_id"), F.col("text_crc32"), F.col("size")) % blocks).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = alike.groupBy("shard", "block").agg(F.sum("n").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "block"]).withColumn("first", F.col("before") + F.col("at"))
    few = placed.where(F.col("n") <= PIECE).withColumn("end", F.col("first") + F.col("n") - 1)
    pieces = placed.where(F.col("n") > PIECE).withColumn("end", F.col("first") + F.col("n") - 1)
    pieces = pieces.withColumn("first", F.explode(F.sequence("first", "end", F.lit(PIECE)))).withColumn("end", F.least("end", F.col("first") + PIECE - 1))
    pieces = pieces.repartition(partitions(docs.sparkSession), "shard", "first")
    slots = few.union(pieces).withColumn("slot", F.explode(F.sequence("first", "end")))
    return slots.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))


def _tree(leaves: list[Leaf]) -> dict[tuple[str, str], float]:
    """Weights of nodes with their children, for the SQL."""
    out: dict[tuple[str, str], float] = {}
    for region, rack, number, weight in leaves:
        path = ["", region, f"{region}/{rack}", f"{region}/{rack}/{number}"]
        for edge in zip(path, path[1:]):
            out[edge] = out.get(edge, 0.0) + weight
    return out


_NODES = ", ".join(f"({n}, '{node}', '{child}', {weight}::DOUBLE)" for n in (SHARDS, SHARDS + 1) for (node, child), weight in _tree(layout(n)).items())
_STEP = """level{0} AS (SELECT r, n, arg_max(child, ln((('0x' || substr(md5(child || chr(10) || key), 1, 13))::BIGINT + 0.5) / 4503599627370496::DOUBLE) / weight) AS here
    FROM (SELECT l.r, l.n, l.here, coalesce(doc_id::VARCHAR, '') AS key FROM level{1} l JOIN sized USING (r)) JOIN tree USING (n) WHERE node = here GROUP BY r, n)"""
# The CRC-32 of bytes: each is met by eight shifts, which -1 stands for.
SQL = f"""
WITH tree(n, node, child, weight) AS (VALUES {_NODES}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, coalesce(string_split(hex(encode(text)), ''), []) AS h FROM documents),
sized AS (SELECT r, doc_id, size, CASE WHEN size = 8 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(h) // 2 + 1),
    lambda i: [(16 * (instr('0123456789ABCDEF', h[2 * i - 1]) - 1) + instr('0123456789ABCDEF', h[2 * i]) - 1)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) END AS text_crc32 FROM docs),
level0 AS (SELECT r, n, '' AS here FROM sized, (VALUES ({SHARDS}), ({SHARDS + 1})) AS v(n)),
{_STEP.format(1, 0)}, {_STEP.format(2, 1)}, {_STEP.format(3, 2)},
placed AS (SELECT r, split_part(here, '/', 3)::INTEGER AS s, n FROM level3),
rows AS (SELECT doc_id, size, text_crc32, a.s AS shard, b.s AS grown_shard, (SELECT greatest(1, ceil(count(*) / {BLOCK_ROWS * SHARDS}.0))::BIGINT FROM sized) AS blocks
    FROM sized JOIN placed a ON a.r = sized.r AND a.n = {SHARDS} JOIN placed b ON b.r = sized.r AND b.n = {SHARDS + 1})
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard
    ORDER BY ('0x' || substr(md5('block' || chr(10) || coalesce(doc_id::VARCHAR, '') || chr(10) || text_crc32 || chr(10) || size), 1, 13))::BIGINT % blocks, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM rows
"""
