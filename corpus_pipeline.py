"""The cleaning of a corpus, stage by stage; each stage's rows are written and read again as the next one's input.

1. toxicity: documents that the classifier rejects go.
2. near-duplicates: one document of each group stays, the one with the smallest doc_id; two are linked if they share SIMILAR per cent of their five-word shingles.
3. substring dedup: words in passages that occur earlier go; a document of which nothing is left goes.
4. decontamination: documents that hold a window of the benchmark go.
5. byte-level BPE: adds ids, their number, and whether they decode to the text.

Rows of one doc_id are told apart by their texts; repeated rows are one document from stage 2 on. Documents without
words are no duplicates, hold nothing toxic and no passage, and stay. Rows without doc_id are told apart by their texts and treated as others are;
very long texts go through all stages whole; an empty table gives no rows. Columns beside doc_id, text and n_chars pass through every stage
unchanged, whatever their names; where one has the name of a column that the last stage adds, that one gets ``bpe_`` before its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, minhash, positional_index, substrings, toxicity
from corpusloom.llm.tables import noting, read, remove, shared_dir

#: Per cent of the union of shingles from which two documents are near copies; op6 has a threshold of its own.
SIMILAR = 80
#: The stages decide on learnt scores and write token ids, which SQL can't state.
ORACLE_SQL = None


_OWN = {"doc_id", "text", "n_chars"}


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """work, with all columns but its own under names that meet no name in it."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        under = [c if c in _OWN else f"carried_{i}" for i, c in enumerate(names)]
        out = work(spark, docs.toDF(*under), sf_dir)
        back = dict(zip(under, names))
        taken, final = {c.lower() for c in names}, []
        for c in out.columns:
            name = back.get(c, c)
            while c not in back and name.lower() in taken:
                name = f"bpe_{name}"
            final.append(name)
        return out.toDF(*final)

    return run


@stage
def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(docs.columns)


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, threshold=SIMILAR)
    texts = found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("key").alias("text_key"), "rows")).alias("first")
    kept = texts.where("group is not null").groupBy("group").agg(first).select("first.*")
    kept = kept.select("id", "text_key", "rows").union(texts.where("group is null").select("doc_id", "key", "rows"))
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_key")))
    repeated = rows.where("rows > 1").dropDuplicates(["doc_id", "text_key"])
    return rows.where("rows = 1").union(repeated).select(docs.columns)


@stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


@stage
def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = positional_index.find_phrases(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0")
    found = found.select(F.col("doc_id").alias("id"), F.col("key").alias("text_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_key"))
    return docs.join(found, same, "left_anti")


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(docs, with_decoded=True)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(*docs.columns, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", not_contaminated),
    ("byte_bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all stages leave of documents."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, work in STAGES:
        at = f"{shared_dir(spark)}/pipeline-{name}-{uuid4().hex}"
        with noting() as own:
            work(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        # what the stage wrote on its way, and what it read, is needed no more
        remove(spark, [*own, *([before] if before else [])])
        before = at
    return docs
