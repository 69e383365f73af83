"""A chunk store that is changed by whole buckets: a batch reads and writes the buckets of its own documents only.

Layout, below the store's folder:

    chunks/bucket=B/gen=G   rows of chunks, as generation G left the bucket
    docs/bucket=B/gen=G     (doc_id, ticker, digest, version) of the documents in them
    heads/G                 one row a bucket: the generation that holds it now

A change writes the new generation of the buckets that it touches (in place of what an earlier, broken attempt at
the same generation left there), and then the next heads. Readers take the last heads that were written to their end, so
a crash before that leaves the state before the change, whole. Generations that no heads name go with `vacuum`. One
writer at a time; readers need no lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.shared import child_names, delete_folder, path_exists

DOCS = "doc_id long, ticker string, digest string, version int"
HEADS = "bucket int, gen long, n_buckets int, chunk_schema string"


class ChunkStore:
    """Documents' chunks by buckets of a hash of doc_id; n_buckets holds for a new store."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int = 64):
        self.spark, self.path, self.new_buckets = spark, path.rstrip("/"), n_buckets

    # --- heads ---

    def generation(self) -> int:
        """The last generation whose heads are complete; 0 for no store."""
        names = [int(n) for n in child_names(self.spark, f"{self.path}/heads") if n.isdigit()]
        return max((g for g in names if path_exists(self.spark, f"{self.path}/heads/{g}/_SUCCESS")), default=0)

    def _heads(self) -> tuple[int, dict[int, int], int, str | None]:
        """(generation, generation by bucket, number of buckets, schema of chunks); one row a bucket comes to the driver."""
        now = self.generation()
        if not now:
            return 0, {}, self.new_buckets, None
        rows = self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/{now}").collect()
        return now, {r["bucket"]: r["gen"] for r in rows if r["bucket"] >= 0}, rows[0]["n_buckets"], rows[0]["chunk_schema"]

    def _commit(self, gen: int, heads: dict[int, int], n_buckets: int, schema: str) -> None:
        rows = [(b, g, n_buckets, schema) for b, g in heads.items()] or [(-1, gen, n_buckets, schema)]
        self.spark.createDataFrame(rows, HEADS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/{gen}")

    # --- reading ---

    def _read(self, kind: str, schema: T.StructType | str, heads: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/bucket={b}/gen={g}" for b, g in sorted(heads.items()) if buckets is None or b in buckets]
        paths = [p for p in paths if path_exists(self.spark, p)] if kind == "chunks" else paths  # documents may have no chunk
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chunks(self, buckets: set[int] | None = None) -> DataFrame:
        """All chunks as of now, or those of some buckets."""
        _, heads, _, schema = self._heads()
        return self._read("chunks", T.StructType() if schema is None else T.StructType.fromJson(_json(schema)), heads, buckets)

    def documents(self, buckets: set[int] | None = None) -> DataFrame:
        """(doc_id, ticker, digest, version) of all documents, or those of some buckets."""
        return self._read("docs", DOCS, self._heads()[1], buckets)

    def bucket(self, doc_id: Column | str = "doc_id", n_buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(n_buckets or self._heads()[2])).cast("int")

    def buckets_of(self, docs: DataFrame) -> set[int]:
        """Buckets of some documents; at most as many as the store has."""
        return {r[0] for r in docs.select(self.bucket().alias("b")).distinct().collect()}

    # --- changes ---

    def changed(self, docs: DataFrame) -> DataFrame:
        """The documents of (doc_id, digest, ...) that are not stored with that digest, with their next version.

        Reads the documents of their buckets only.
        """
        held = self.documents(self.buckets_of(docs)).select("doc_id", F.col("digest").alias("_d"), F.col("version").alias("_v"))
        fresh = docs.join(held, "doc_id", "left").where("_v is null or _d is null or _d <> digest")
        return fresh.withColumn("version", (F.coalesce("_v", F.lit(0)) + 1).cast("int")).drop("_v", "_d")

    def upsert(self, docs: DataFrame, chunks: DataFrame) -> int:
        """Put documents (doc_id, ticker, digest, version) and all their chunks in place of what is held of them.

        Gives the generation; that of before where docs is empty. Ids are taken as they come: one row a document. A
        null digest says that the document is to be taken again.
        """
        return self._rewrite(docs, docs.selectExpr("doc_id", "ticker", "digest", "version"), chunks)

    def remove(self, docs: DataFrame) -> int:
        """Take out documents (doc_id)."""
        return self._rewrite(docs, None, None)

    def clear(self, ticker: str) -> int:
        """Take out all documents of a ticker, whose letter case does not count."""
        return self.remove(self.documents().where(F.upper("ticker") == ticker.upper()).select("doc_id"))

    def _rewrite(self, gone: DataFrame, docs: DataFrame | None, chunks: DataFrame | None) -> int:
        now, heads, n_buckets, schema = self._heads()
        touched = {r[0] for r in gone.select(self.bucket(n_buckets=n_buckets).alias("b")).distinct().collect()}
        if docs is None:
            touched &= set(heads)
        if not touched:
            return now
        kinds = {"docs": (DOCS, docs)}
        if schema is not None or chunks is not None:
            kinds["chunks"] = (chunks.schema if schema is None else T.StructType.fromJson(_json(schema)), chunks)
        kept_schema = schema
        for b in touched:  # what a broken attempt at this generation left
            for kind in kinds:
                delete_folder(self.spark, f"{self.path}/{kind}/bucket={b}/gen={now + 1}")
        for kind, (own, new) in kinds.items():
            old = self._read(kind, own, heads, touched).join(gone.select("doc_id"), "doc_id", "left_anti")
            rows = old if new is None else old.unionByName(new, allowMissingColumns=True)
            self._write(kind, rows, now + 1, n_buckets)
            if kind == "chunks":
                kept_schema = rows.schema.json()
        full = {b for b in touched if path_exists(self.spark, f"{self.path}/docs/bucket={b}/gen={now + 1}")}
        heads = {b: g for b, g in heads.items() if b not in touched} | dict.fromkeys(full, now + 1)
        self._commit(now + 1, heads, n_buckets, kept_schema or T.StructType().json())
        return now + 1

    def _write(self, kind: str, rows: DataFrame, gen: int, n_buckets: int) -> None:
        """Rows as files of one generation, one task a bucket."""
        placed = rows.withColumns({"bucket": self.bucket(n_buckets=n_buckets), "gen": F.lit(gen)})
        writer = placed.repartition("bucket").write.partitionBy("bucket", "gen").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{kind}")

    def resize(self, n_buckets: int) -> int:
        """Deal the whole store to another number of buckets, as buckets outgrow a task."""
        now, heads, _, schema = self._heads()
        self._write("docs", self._read("docs", DOCS, heads), now + 1, n_buckets)
        if schema is not None:
            self._write("chunks", self._read("chunks", T.StructType.fromJson(_json(schema)), heads), now + 1, n_buckets)
        full = [r[0] for r in self.documents().select(self.bucket(n_buckets=n_buckets)).distinct().collect()]
        self._commit(now + 1, dict.fromkeys(full, now + 1), n_buckets, schema or T.StructType().json())
        return now + 1

    def vacuum(self) -> int:
        """Delete generations and heads that the present ones do not need; gives how many folders went."""
        now, heads, _, _ = self._heads()
        gone = [f"heads/{n}" for n in child_names(self.spark, f"{self.path}/heads") if n != str(now)]
        for kind in ("docs", "chunks"):
            for folder in child_names(self.spark, f"{self.path}/{kind}"):
                if folder.startswith("bucket="):
                    keep = f"gen={heads.get(int(folder.removeprefix('bucket=')))}"
                    gone += [f"{kind}/{folder}/{g}" for g in child_names(self.spark, f"{self.path}/{kind}/{folder}") if g != keep]
        for name in gone:
            delete_folder(self.spark, f"{self.path}/{name}")
        return len(gone)


def _json(schema: str) -> dict:
    import json

    return json.loads(schema)
