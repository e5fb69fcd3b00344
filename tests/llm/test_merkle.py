import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest

from corpusloom.llm import merkle, sql
from corpusloom.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes):
    """The root of some digests, and of each its siblings, level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for way, i in zip(ways, at):
            run = i // 16 * 16
            way.append((level[run:i], level[i + 1 : run + 16]))
        level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [i // 16 for i in at]
    return level[0] if level else None, ways


def plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        at = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = at, *climb([leaf(r, r[4]) for r in at])
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        at, subroot, ways = trees[s]
        for r, way in zip(at, ways):
            way = way + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4])
            for a, z in way:
                now = h(*a, now, *z)
            out.append((r[0], leaf(r, r[4]), subroot, root, h(*(x for a, z in way for x in (*a, *z))), now, now == root))
    return out


def rows_of(n=700):
    rows = [(i, f"s{i % 19}" if i % 3 else "hot", "de" if i % 2 else None, i, f"Text É {i}" if i % 4 else f"text {i}") for i in range(n)]
    rows += [(7, "s7", None, 1, "again"), (7, "s7", None, 1, "again"), (None, "s1", "x", None, None), (None, None, None, None, ""), (1_000, None, "", 0, "A" * 300_000)]
    return rows + [(2_000, "lone", "x", 1, "One"), (2_005, "", "x", 1, "empty source"), (-5, "é", "x", 1, "Below"), *[(5_000 + i, "z16", "x", 1, "T") for i in range(16)], *[(6_000 + i, "z17", "x", 1, "T") for i in range(17)]]


def test_manifest_is_that_of_a_plain_tree(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 tree", "2 level", "'x' digest").repartition(5)
    got = [tuple(r) for r in manifest(df).collect()]
    assert Counter(got) == Counter(plain(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_sql_says_the_same(spark):
    rows = rows_of(300)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert Counter(con.sql(sql.MANIFEST).fetchall()) == Counter(plain(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes_around_full_runs(spark, n):
    rows = [(i, "s", "x", 1, f"A{i}") for i in range(n)]
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(plain(rows))


def test_a_source_is_spread_over_partitions(spark):
    df = spark.range(4_000).selectExpr("'one' tree", "1L id", "'d' digest", "id row")
    parts = merkle.numbered(df, "id", "digest", "row")
    assert sorted(r["at"] for r in parts.collect()) == list(range(4_000))
    sizes = [r["count"] for r in spark.read.parquet(merkle.written[-1]).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2_000
