import random

import pytest

import corpus_pipeline
from corpus_pipeline import STAGES, encoded, not_contaminated, not_toxic, one_of_each_group, run, without_repeats


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted cases: (rows, sf_dir)."""
    rng = random.Random(3)
    at = str(tmp_path_factory.mktemp("sf"))
    rows = {i: prose(rng, rng.randint(60, 120)) for i in range(400)}
    toxic = set(range(0, 400, 4))
    for i in toxic:
        w = rows[i].split()
        w.insert(rng.randrange(len(w)), rng.choice(["snarkface", "grumblefool"]))
        rows[i] = " ".join(w)
    item, passage = prose(rng, 14), prose(rng, 60)
    rows[401] = rows[1]  # an exact copy
    rows[402] = rows[2].replace(rows[2].split()[0], "changed", 1)  # a near copy
    rows[403] = f"{rows[5][:200]} {item} tail"
    rows[410] = f"{prose(rng, 30)} {passage} {prose(rng, 30)}"
    rows[411] = f"{prose(rng, 40)}  {passage}\n{prose(rng, 20)}"
    rows[412] = passage
    rows[420], rows[421], rows[422] = "", None, "  two  words \n"
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows.items()] + [(3, rows[3], "en", "s", len(rows[3])), (None, prose(rng, 50), "en", "s", 7), (None, prose(rng, 50), None, None, None)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return rows, toxic, passage, at


def test_order_of_stages():
    assert [f for _, f in STAGES] == [not_toxic, one_of_each_group, without_repeats, not_contaminated, encoded]
    assert corpus_pipeline.ORACLE_SQL is None


def test_planted_cases_go_and_clean_documents_stay(spark, corpus):
    rows, toxic, passage, at = corpus
    got = {}
    for r in run(spark, at).collect():
        assert r.decodes and r.n_tokens * 4 == len(r.ids)
        got.setdefault(r.doc_id, []).append(r.text)
    clean = set(range(400)) - toxic
    assert len(clean & set(got)) >= 0.97 * len(clean)
    assert len(toxic & set(got)) <= 0.03 * len(toxic)
    assert {401, 402, 403, 412}.isdisjoint(got)
    assert {410, 420, 421, 422} <= set(got)
    assert len(got[3]) == 1 and len(got[None]) == 2
    assert all(texts == [rows[i]] for i, texts in got.items() if i in clean)
    assert sum(passage in (t or "") for texts in got.values() for t in texts) == 1
    assert got[411] and passage.split()[30] not in got[411][0]


def test_stages_keep_the_columns_and_stand_empty_tables(spark, corpus):
    at = corpus[-1]
    empty = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in STAGES:
        out = stage(spark, empty, at)
        assert out.columns[: len(empty.columns)] == empty.columns
        assert out.count() == 0


def test_near_copies_from_four_fifths_on_are_one_group(spark):
    rng = random.Random(9)
    rows = []
    for n in range(30):
        words = prose(rng, 104).split()  # 100 shingles
        near, far = list(words), list(words)
        near[20], near[60] = "changed", "changed"  # 90 of 110 shingles: 0.82
        far[20], far[50], far[80] = "other", "other", "other"  # 85 of 115, 0.74; 75 of 125 with near
        rows += [(3 * n, " ".join(words)), (3 * n + 1, " ".join(near)), (3 * n + 2, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in one_of_each_group(spark, docs, "").collect()} == {i for i, _ in rows if i % 3 != 1}


def test_any_other_columns_pass_through_unchanged(spark, corpus):
    at = corpus[-1]
    names = "id rows text_key block seq kept n_words score held_out predicted ids n_tokens decodes group key bpe_ids Component carried_0".split()
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id % 3 = 0")
    docs = docs.selectExpr(*[f"concat('{n}', doc_id) as `{n}`" for n in names], "doc_id", "text", "n_chars")
    plain, added = docs.select("doc_id", "text", "n_chars"), None
    for _, work in STAGES:
        out, without = work(spark, docs, at).cache(), work(spark, plain, at).cache()
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in without.collect())
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        added = out.columns[len(docs.columns) :]
        docs, plain = out, without
    assert added == ["bpe_n_tokens", "bpe_bpe_ids", "bpe_decodes"]
