"""Incremental pipeline: new and changed files into the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.fiscal import stamp_period
from ledgerloom.operators.docs import chunk_records, chunk_text, classify_documents, split_sections
from ledgerloom.operators.retrieval import drop_failed, embed
from ledgerloom.sources.shared import kept_on_disk
from ledgerloom.sources.store import ChunkStore


def prepare_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, documents refused) of (doc_id, ticker, file_name, text, doc_type).

    A null doc_type is found from the text; documents of no known type are refused. Chunks carry the period that
    the file's name or head states; those without words have no vector.
    """
    typed = docs.withColumn("doc_type", F.coalesce("doc_type", classify_documents(F.col("text"))))
    known = typed.where("doc_type <> 'other'").select("*", F.inline(F.array(stamp_period("file_name", "text"))))
    cut = chunk_text(split_sections(known).join(known.select("doc_id", "doc_type"), "doc_id"))
    return embed(chunk_records(cut, known), idf=False), typed.where("doc_type = 'other'")


def ingest_batch(store: ChunkStore, batch: DataFrame) -> DataFrame:
    """Put a batch of documents (doc_id, text; ticker, file_name, doc_type or none) into the store; gives its counts.

    Documents that are stored with the same text are left out, and only buckets with others are read in full or
    written. Of rows that repeat an id the one with the largest digest counts; a document that is refused leaves what is
    stored. Chunks without a vector are not stored, and their document is taken again when it comes again.
    """
    absent = {c: F.lit(None).cast("string") for c in ("ticker", "file_name", "doc_type") if c not in batch.columns}
    docs = (batch.withColumns(absent) if absent else batch).where("doc_id is not null")
    docs = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    one = F.max_by(F.struct(*[c for c in docs.columns if c != "doc_id"]), "digest")
    docs = docs.groupBy("doc_id").agg(one.alias("r")).select("doc_id", "r.*")
    typed = store.changed(docs).withColumn("doc_type", F.coalesce("doc_type", classify_documents(F.col("text"))))
    with kept_on_disk(typed) as fresh:  # read several times, typed once
        chunks, refused = prepare_chunks(fresh)
        chunks = chunks.join(fresh.select("doc_id", "ticker", "digest", "version"), "doc_id")
        with kept_on_disk(chunks) as made:
            good, failed = drop_failed(made)
            lost = made.where("embedding is null or size(embedding) = 0").select("doc_id", F.lit(True).alias("lost")).distinct()
            taken = fresh.join(refused.select("doc_id"), "doc_id", "left_anti").join(lost, "doc_id", "left")
            store.upsert(taken.withColumn("digest", F.when(F.col("lost").isNull(), F.col("digest"))), good)
            sizes = [fresh.agg(F.count("*").alias("n_docs")), refused.agg(F.count("*").alias("n_refused"))]
            sizes.append(failed.select(F.col("n_all").alias("n_chunks"), F.coalesce("n_failed", F.lit(0)).alias("n_failed")))
            row = sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])  # one row each
            return row.sparkSession.createDataFrame(row.collect(), row.schema)


def ingest_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, counts: str | None = None, n_buckets: int = 64):
    """Start a stream that types, cuts, stamps and embeds new or changed documents and puts them into a ChunkStore.

    source: folder of parquet files, as ingest_batch takes them. A batch may run again. counts: folder for one row a batch
    of documents, refused ones, chunks and failed ones.
    """
    chunk_store = ChunkStore(spark, store, n_buckets)

    def write(batch: DataFrame, number: int) -> None:
        row = ingest_batch(chunk_store, batch)
        if counts is not None:
            row.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
