"""Exact search over chunk vectors under strict filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import r
from ledgerloom.functions.fiscal import fiscal_window
from ledgerloom.operators.pairs import pairs_within, similar
from ledgerloom.operators.topk import TopK

#: Domains of topics, the words that go before a topic, and how many hits a topic has.
DOMAINS = (
    ("guidance", "management guidance outlook expected target", 5),
    ("competitive", "competitive advantage moat market share competitors", 3),
    ("capital", "capital allocation capex dividend buyback acquisition", 3),
    ("governance", "management board directors related party auditor", 3),
)
#: What stands before or after a topic in forward-looking passages.
TOPIC_AFTER = r"(?i)(?:we expect|guidance|outlook|target|aim to|going forward).*?"
TOPIC_BEFORE = r".*?(?:we expect|guidance|outlook|target)"
#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is empty, zero or of another length."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), F.nullif(norms, F.lit(0.0))), F.lit(0.0)))


def search(chunks: DataFrame, queries: DataFrame, k: int, filters: dict[str, object] | None = None, min_year: int | None = None) -> DataFrame:
    """The k most similar chunks of each query among those that pass every filter.

    chunks: (vec_id, metadata..., embedding); queries: (query_id, qvec) and, for a filter by the query itself,
    columns named q_<column>: null asks for all, anything else must be equal. Filters that hold for all come before
    the similarity, so that they reach the scan. Chunks stay where they are read: a task compares its own with a block of
    queries (TopK: exact, by block products, leaving out cells that cannot reach a query's best) and passes on k rows a
    query at most. The block of queries is broadcast; it is cut so that its vectors take BLOCK_BYTES at most.
    """
    total, size = queries.agg(F.count("*"), F.max(F.size("qvec"))).first()
    blocks = -(-total * 8 * max(size or 0, 8) // BLOCK_BYTES) or 1
    if blocks > 1:
        part = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))
        return reduce(DataFrame.unionByName, [search(chunks, queries.where(part == b), k, filters, min_year) for b in range(2 * blocks)])
    rows = chunks.where("embedding is not null")
    for name, wanted in (filters or {}).items():
        values = [str(v).upper() if name == "ticker" else v for v in (wanted if isinstance(wanted, (list, tuple)) else [wanted])]
        rows = rows.where(F.col(name).isin(*values))
    if min_year is not None:
        rows = rows.where(F.col("cal_year") >= min_year)
    own = [c[2:] for c in queries.columns if c.startswith("q_")]
    asked = queries.collect()  # one block, bounded above
    spark = chunks.sparkSession
    vectors, wanted = [q["qvec"] for q in asked], {c: [q[f"q_{c}"] for q in asked] for c in own}
    shared = spark.sparkContext.broadcast((vectors, wanted))
    plain = [c for c in rows.columns if c != "embedding"]
    schema = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("_mark", T.IntegerType()), *[rows.schema[c] for c in plain]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(*shared.value, k)
        for batch in batches:
            best.add(batch, "vec_id", "embedding")
        for query, mark, kept in best.results():
            table = kept.add_column(0, "_mark", pa.array(mark, pa.int32())).add_column(0, "_q", pa.array(query, pa.int32()))
            yield from table.combine_chunks().to_batches()

    found = rows.mapInArrow(run, schema)
    w = Window.partitionBy("_q").orderBy(F.desc("_mark"), "vec_id")
    first = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).withColumn("relevance", F.col("_mark") / 1000)
    kept = [c for c in queries.columns if c != "qvec" and not c.startswith("q_")]
    names = spark.createDataFrame([(i, *[q[c] for c in kept]) for i, q in enumerate(asked)], T.StructType([T.StructField("_q", T.IntegerType()), *[queries.schema[c] for c in kept]]))
    return first.join(F.broadcast(names), "_q").select(*plain, *kept, "relevance", "place")


def with_sentinel(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query has a row: one of relevance 0 and without an id where nothing was found."""
    out = queries.select("query_id").join(hits, "query_id", "left")
    return out.withColumns({"relevance": F.coalesce("relevance", F.lit(0.0)), "place": F.coalesce("place", F.lit(1)), "found": F.col("vec_id").isNotNull()})


def topic_text(domain: Column, topic: Column) -> Column:
    """What a topic is searched with: its domain's words, then the topic; null for an unknown domain."""
    words = F.create_map(*[F.lit(x) for name, text, _ in DOMAINS for x in (name, text)])
    return F.concat(F.try_element_at(words, domain), F.lit(" "), topic)


def topic_search(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The chunks of a request's ticker that are most like its topic, as many as its domain has; a sentinel where none is.

    requests: (query_id, domain, ticker, qvec), qvec the vector of topic_text. A request without a ticker finds nothing.
    """
    limit = F.create_map(*[F.lit(x) for name, _, k in DOMAINS for x in (name, k)])
    asked = requests.where("ticker is not null").select("query_id", "qvec", F.upper("ticker").alias("q_ticker"))
    hits = search(chunks, asked, max(k for _, _, k in DOMAINS))
    own = hits.join(requests.select("query_id", F.try_element_at(limit, F.col("domain")).alias("_limit")), "query_id")
    return with_sentinel(own.where(F.col("place") <= F.col("_limit")).drop("_limit"), requests)


def topic_passages(requests: DataFrame, k: int = 3, cut: int = 800, least: int = 30) -> DataFrame:
    """Passages of a request's own text, for requests that name no ticker: (query_id, place, passage, score).

    requests: (query_id, topic, doc). Paragraphs are ranked by how often they hold the topic's words of over two
    letters, then by place; short paragraphs do not count. A request without a hit has one row, `Not found`.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    terms = F.filter(F.split(F.lower("topic"), r"\s+"), lambda t: F.length(t) > 2)
    rows = requests.select("query_id", terms.alias("_t"), F.posexplode(F.split("doc", r"\n\s*\n")).alias("_at", "_p"))
    rows = rows.withColumn("_p", bare("_p")).where(F.length("_p") >= least)
    low = F.lower("_p")
    times = lambda t: F.floor((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("int")
    score = F.aggregate(F.transform("_t", times), F.lit(0), lambda acc, n: acc + n)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_at"))
    best = rows.withColumn("score", score).where("score > 0").withColumn("place", place).where(F.col("place") <= k)
    out = requests.select("query_id").join(best.select("query_id", "place", F.substring("_p", 1, cut).alias("passage"), "score"), "query_id", "left")
    return out.withColumns({"place": F.coalesce("place", F.lit(1)), "passage": F.coalesce("passage", F.lit("Not found")), "score": F.coalesce("score", F.lit(0))})


def topic_guidance(requests: DataFrame, k: int = 5, before: int = 100, after: int = 300) -> DataFrame:
    """The first forward-looking passages on a topic in a request's own text: (query_id, place, passage).

    requests: (query_id, topic, doc). First those that lead to the topic, then those that follow it, each with
    what stands around its start. A request without a hit has one row that says so; a null text or topic has none.
    """
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, topic, doc in zip(pdf["id"], pdf["topic"], pdf["doc"], strict=True):
                asked = re.escape(topic)
                starts = [m.start() for p in (TOPIC_AFTER + asked, "(?i)" + asked + TOPIC_BEFORE) for m in re.finditer(p, doc)][:k]
                found = [doc[max(0, a - before) : a + after].strip() for a in starts] or [f"No guidance found for '{topic}'"]
                out += [(key, n, p) for n, p in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["id", "place", "passage"])

    kind = requests.schema["query_id"].dataType.simpleString()
    rows = requests.where("doc is not null and topic is not null").select(F.col("query_id").alias("id"), "topic", "doc")
    return rows.mapInPandas(run, f"id {kind}, place int, passage string").withColumnRenamed("id", "query_id")


def window_policy(requests: DataFrame) -> DataFrame:
    """Filter columns of a request: the period if one is asked, none if all or a least year, else the recent window."""
    free = F.col("all_periods") | F.col("min_year").isNotNull()
    exact = F.col("asked_period").isNotNull()
    return requests.select("request_id", F.when(exact, F.col("asked_period")).alias("period"), F.when(~exact & ~free, fiscal_window("active_period")).alias("years"), F.when(~exact, F.col("min_year")).alias("min_year"))


def multi_query(hits: DataFrame, texts: DataFrame, n: int = 12, cut: int = 1500, key_chars: int | None = None) -> DataFrame:
    """Hits of several queries, one for each distinct text in the order of queries, cut and numbered.

    key_chars: letters that decide whether two texts are the same; the md5 of all of them if null.
    """
    rows = hits.join(texts, "vec_id")
    key = F.md5(F.col("text").cast("binary")) if key_chars is None else F.substring("text", 1, key_chars)
    first = Window.partitionBy("_t").orderBy("query_id", "place", "vec_id")
    rows = rows.withColumn("_t", key).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    order = F.row_number().over(Window.partitionBy("group_id").orderBy("query_id", "place", "vec_id"))
    rows = rows.withColumn("group_id", F.lit(0)) if "group_id" not in rows.columns else rows
    return rows.withColumn("n", order).where(F.col("n") <= n).select("group_id", "n", "query_id", "vec_id", "relevance", F.substring("text", 1, cut).alias("text"))


def assemble(chunks: DataFrame, queries: DataFrame, texts: DataFrame, years: list[str], k: int = 5) -> DataFrame:
    """Hits of each ticker within the window; tickers that get none are searched again without it."""
    narrow = search(chunks.where(F.col("fiscal_year").isin(*years)), queries, k)
    empty = queries.join(narrow.select(F.col("ticker").alias("q_ticker")).distinct(), "q_ticker", "left_anti")
    both = narrow.withColumn("widened", F.lit(False)).unionByName(search(chunks, empty, k).withColumn("widened", F.lit(True)))
    rows = both.join(texts, "vec_id")
    body = F.array_sort(F.collect_list(F.struct("query_id", "place", "text")))
    return rows.groupBy("ticker").agg(F.count("*").alias("n_chunks"), F.max("widened").alias("widened"), F.md5(F.array_join(F.transform(body, lambda x: x["text"]), "\n").cast("binary")).alias("text_md5"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct types and years of every ticker, exact."""
    return chunks.groupBy("ticker").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_set("doc_type")).alias("doc_types"), F.sort_array(F.collect_set("fiscal_year")).alias("fiscal_years"))


def drop_failed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector, and how many there are with and without one."""
    bad = F.col("embedding").isNull() | (F.size("embedding") == 0)
    counts = chunks.agg(F.count("*").alias("n_all"), F.sum(bad.cast("long")).alias("n_failed"))
    return chunks.where(~bad), counts


def upsert_chunks(store: DataFrame, batch: DataFrame, key: str = "vec_id") -> DataFrame:
    """Rows of the store that the batch does not replace, and the batch; applying it twice changes nothing."""
    return store.join(batch.select(key), key, "left_anti").unionByName(batch.dropDuplicates([key]))


def clear(store: DataFrame, ticker: str) -> DataFrame:
    return store.where(F.col("ticker") != ticker.upper())


def embed(texts: DataFrame, dims: int = 256, idf: bool = True) -> DataFrame:
    """Unit vectors of distinct texts by hashed words; null for texts without words.

    idf: weigh words by inverse document frequency over all texts given; without it a vector depends on its text alone.
    """
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    distinct = texts.select("text").where("text is not null").distinct()
    words = distinct.withColumn("_w", F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != ""))
    rows = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
    if idf:
        rows = IDF(inputCol="_tf", outputCol="_idf").fit(rows).transform(rows)
    unit = Normalizer(inputCol="_idf" if idf else "_tf", outputCol="_u").transform(rows).select("text", vector_to_array("_u").alias("_v"))
    unit = unit.select("text", F.when(F.exists("_v", lambda x: x != 0), F.col("_v")).alias("embedding"))
    return texts.join(unit, "text", "left")


def band_pairs(df: DataFrame, group: str, lo: float, hi: float, block: int = 2000) -> DataFrame:
    """Pairs of one group with a cosine in the band.

    A group is cut into blocks of `block` rows or, in larger groups, of a share of them; a task compares two blocks by
    products and holds no more than them, however large the group is. A null group or vector has no pairs.
    """
    rows = df.select(F.col(group).alias("g"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = similar(pairs_within(rows, lo, hi, block).where("x_id <> y_id"), lo, hi)
    return pairs.select("g", F.least("x_id", "y_id").alias("a_id"), F.greatest("x_id", "y_id").alias("b_id"), "similarity")
