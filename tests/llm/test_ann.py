import numpy as np

from corpusloom.llm import ann
from corpusloom.llm.ann import Codebook, build_index, search, vectors


def brute(rows, k, every):
    """query_id, rank, vec_id, score by full scans; rows: id to vector."""
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], np.float64)
    out = []
    for n, q in enumerate(ids):
        if q % every == 0:
            s = (x * x[n]).sum(1)
            near = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != n)[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(near)]
    return out


def found(df, k, every, **more):
    rows, dimension = vectors(df)
    index, book = build_index(rows, dimension)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search(index, book, rows.where(f"vec_id % {every} = 0"), k, **more).collect())


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    rows = {i: v / np.linalg.norm(v) for i, v in enumerate(rng.standard_normal((4_000, 32)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    want, got = brute(rows, 20, 200), found(df, 20, 200)
    assert len(got) == len(want)
    pairs = {(q, i): s for q, _, i, s in want}
    hits = [(q, i, s) for q, _, i, s in got if (q, i) in pairs]
    assert len(hits) >= 0.95 * len(want)
    assert all(abs(pairs[q, i] - s) < 1e-12 for q, i, s in hits)


def test_odd_rows_and_many_copies(spark):
    copies = {i: [1.0, 0.5, 0.25] for i in range(1, 400)}
    rows = copies | {400: [2.0, 0.0, 0.0], 401: [-1.0, 0.0, 0.0]}
    data = [(i, v, "old", 7) for i, v in rows.items()] + [(5, [1.0, 0.5, 0.25], "old", 7), (None, [9.0, 9.0, 9.0], "x", 1), (500, None, "x", 1), (501, [0.0, 0.0, 0.0], "x", 1), (502, [float("nan"), 1.0, 1.0], "x", 1), (503, [None, 1.0, 1.0], "x", 1), (504, [float("inf"), 1.0, 1.0], "x", 1), (505, [1.0, 2.0], "x", 1), (506, [], "x", 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, vector string, score int")
    assert found(df, 5, 100, depth=8) == brute(rows, 5, 100)


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = {0: [1.0], 20: [3.0], 7: [-2.0]}
    assert found(spark.createDataFrame(list(rows.items()), schema), 20, 20) == brute(rows, 20, 20)
    assert found(spark.createDataFrame([], schema), 20, 20) == []
    assert found(spark.createDataFrame([(0, None)], schema), 20, 20) == []


def test_codes_mind_the_parallel_residual():
    x = np.random.default_rng(2).standard_normal((2_000, 64))
    book = Codebook.learn(x, 64)
    coarse = book.coarse[book.nearest(x)]
    parts = book.split(x - coarse)

    def loss(codes):
        r = np.concatenate([parts[s] - book.centroids[s][codes[s]] for s in range(book.pairs)], 1)
        return ((r * r).sum(1) + (book.eta - 1) * (r * x).sum(1) ** 2 / (x * x).sum(1)).mean()

    assert loss(book.codes(x)) < loss(book.codes(x, sweeps=0))
    q = x[:3]
    tables, codes = book.tables(q), book.packed(x)
    decoded = np.concatenate([book.centroids[s][c] for s, c in enumerate(book.codes(x))], 1) + coarse
    assert np.allclose(sum(tables[b][codes[:, b]] for b in range(len(tables))), decoded @ q.T, atol=1e-4)


def test_a_grid_of_many_cells_finds_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24)) * 3
    rows = {i: centres[i % 12] + rng.standard_normal(24) for i in range(3_000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    want = {(q, i) for q, _, i, _ in brute(rows, 20, 20)}
    for segment, queries, segments in ((8_192, 8_192, 8), (300, 40, 3)):
        for name, value in (("SEGMENT", segment), ("QUERIES", queries), ("SEGMENTS", segments)):
            monkeypatch.setattr(ann, name, value)
        got = found(df, 20, 20)
        assert len(got) == 150 * 20 and [r[1] for r in got] == [*range(1, 21)] * 150
        assert len(want & {(q, i) for q, _, i, _ in got}) >= 0.95 * len(want)
