"""A training corpus in five stages: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of docs. Nulls, empty texts and repeated rows follow the operators' own rules:
a null text counts as empty where it is compared or packed and stays null where it is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, near_copies, packing, pii, toxicity
from ledgerloom.llm.common import delete_folder, read_table, staged, text_or_empty
from ledgerloom.llm.queries import batch_of
from ledgerloom.sources.shared import new_folder

VOCABULARY, CAPACITY, THRESHOLD = "word_bpe_49k.json", 4096, 0.3

#: Packing, weights and rounds cannot be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold; the model never sees held-out labels."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", use=~toxicity.held_out(F.col("id")))
    return docs.where(toxicity.score(docs, model, docs["text"]) < THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat both, one."""
    groups = exact_dedup.duplicate_groups(docs, batch_of()).select(F.col("keep_id").alias("_id"), F.col("digest").alias("_digest"))
    key = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.sha2(text_or_empty("text"), 256) == F.col("_digest"))
    ids = docs.select(docs["doc_id"].cast("long").alias("i"), F.sha2(text_or_empty("text"), 256).alias("d"))
    repeated = staged(ids.groupBy("i", "d").count().where("count > 1").select("i", "d"))
    keys = staged(groups)
    if repeated.isEmpty():
        return docs.join(keys, key, "left_semi")
    same = F.col("_id").eqNullSafe(F.col("i")) & (F.col("_digest") == F.col("d"))
    once = docs.join(keys.join(repeated, same, "left_anti"), key, "left_semi")
    again = docs.join(keys.join(repeated, same, "left_semi"), key, "left_semi").withColumn("_text", text_or_empty("text"))
    return once.union(again.dropDuplicates(["doc_id", "_text"]).drop("_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the text of the smallest doc_id stays."""
    gone = near_copies.similar_documents(docs).where("not kept").select(F.col("text_sha256").alias("_digest")).distinct()
    return docs.join(staged(gone), F.sha2(text_or_empty("text"), 256) == F.col("_digest"), "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; spans are replaced by their kind and n_chars follows."""
    text = pii.redact(docs["text"])
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its place."""
    return packing.pack_documents(docs, VOCABULARY, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is a table in the shared folder until the next one is written.

    The last such table stays, since the rows returned are read from it.
    """
    docs, held = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if held is not None:
            delete_folder(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
