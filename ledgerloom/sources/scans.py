"""Scans of statements, files, pages and text compilations, and the listings made from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import first_match, r, to_number
from ledgerloom.functions.fiscal import published_date

#: Keywords of headings and the category they start.
CATEGORIES = [
    ("annual report", "annual_reports"),
    ("annual reports", "annual_reports"),
    ("credit rating", "credit_ratings"),
    ("credit ratings", "credit_ratings"),
    ("concall", "concalls"),
    ("concalls", "concalls"),
    ("conference call", "concalls"),
    ("announcement", "announcements"),
    ("announcements", "announcements"),
    ("exchange filing", "announcements"),
    ("presentation", "presentations"),
    ("presentations", "presentations"),
    ("important", "Important"),
]
#: Dates in a document's label, in order.
LABEL_DATES = (
    r"(?i)Financial\s+Year\s+(\d{4})",
    r"(?i)(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4})",
    r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4})",
    r"\b(20\d{2})\b",
)
#: Domains of rating agencies.
RATING_DOMAINS = ("crisil.com", "icra.in", "careratings.com")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, statement, row_no, label, cells): JSON records whose period columns differ from file to file.

    Records hold ticker, statement, row_no and row, an object; its "Line Item" or unnamed member is the label.
    """
    raw = spark.read.schema("ticker string, statement string, row_no int, row map<string,string>").json(path)
    label = F.coalesce(F.try_element_at("row", F.lit("Line Item")), F.try_element_at("row", F.lit("")), F.lit(""))
    cells = F.map_filter("row", lambda k, _: ~k.isin("Line Item", ""))
    return raw.select("ticker", "statement", "row_no", label.alias("label"), F.transform_values(cells, lambda _, v: F.coalesce(v, F.lit(""))).alias("cells"))


def read_quarterly_csv(spark: SparkSession, path: str, ticker: str = r"([^/]+)\.csv$", glob: str = "*.csv") -> DataFrame:
    """(ticker, line_item, period, value) from folders of CSV files; header rows give the quarters.

    ticker: what of a file's path is its ticker, the file's name by default.
    """
    files = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob, wholetext=True)
    lines = files.select(F.regexp_extract(F.col("_metadata.file_path"), ticker, 1).alias("ticker"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    rows = lines.where(F.trim("line") != "").withColumn("c", F.transform(F.split("line", r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))))
    head = rows.where("no = 0").select("ticker", F.col("c").alias("h"))
    cells = rows.where("no > 0").join(head, "ticker").select("ticker", F.element_at("c", 1).alias("line_item"), F.inline(F.arrays_zip(F.slice("h", F.lit(2), F.size("h")).alias("period"), F.slice("c", F.lit(2), F.size("c")).alias("raw"))))
    good = cells.where((F.coalesce("line_item", F.lit("")) != "") & (F.lower("line_item") != "raw pdf") & F.col("period").isNotNull())
    return good.select("ticker", "line_item", "period", to_number("raw", "quarterly").alias("value"))


def file_catalog(spark: SparkSession, root: str, glob: str = "*.{pdf,PDF,csv}") -> DataFrame:
    """(filename, path, size_mb, modified): names and sizes only, the content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), "path", r(F.col("length") / 1048576.0, 2).alias("size_mb"), "modified").dropDuplicates(["path"])


def new_documents(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose name the chunk store does not have."""
    return files.join(chunks.select("filename").distinct(), "filename", "left_anti")


def parse_compilation(lines: DataFrame, tickers: dict[str, str], keys: dict[str, str], only: str | None = None) -> DataFrame:
    """(file, doc_no, company, ticker, segment, text, metadata) from (file, line_no, line) of compilation texts.

    `# N. Company` starts a document, `* **Key**: value` is metadata, `### [Text Block] Segment n` a segment;
    rulers and anchors are dropped. Files are independent; within one, what a line stands under is filled
    forward, first the document by file, then the segment by document.
    """
    rows = lines.where(~F.trim("line").rlike(r"^(-{3,}|<a .*>.*)$"))
    head = F.when(F.col("line").rlike(r"^# \d+\. "), F.struct(F.regexp_extract("line", r"^# (\d+)\. ", 1).cast("int").alias("doc_no"), F.trim(F.regexp_extract("line", r"^# \d+\. (.*)$", 1)).alias("company")))
    rows = rows.withColumn("h", F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no"))).where("h is not null")
    rows = rows.select("file", "line_no", "line", "h.doc_no", "h.company").where(~F.col("line").rlike(r"^# \d+\. "))
    if only:
        rows = rows.where(F.lower("company").contains(only.lower()))
    segment = F.nullif(F.regexp_extract("line", r"^### \[Text Block\] Segment (\d+)", 1), F.lit("")).cast("int")
    tagged = rows.withColumn("segment", F.last(segment, ignorenulls=True).over(Window.partitionBy("file", "doc_no").orderBy("line_no"))).withColumn("starts", segment.isNotNull())
    named = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv])
    key, value = F.regexp_extract("line", r"^\* \*\*(.+?)\*\*: ?(.*)$", 1), F.regexp_extract("line", r"^\* \*\*(.+?)\*\*: ?(.*)$", 2)
    pairs = F.array_sort(F.collect_set(F.struct(F.coalesce(F.try_element_at(named, key), key).alias("k"), F.trim(value).alias("v"))))
    meta = tagged.where(F.col("segment").isNull() & (key != "")).groupBy("file", "doc_no").agg(F.map_from_entries(pairs).alias("metadata"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    text = tagged.where(F.col("segment").isNotNull() & ~F.col("starts")).groupBy("file", "doc_no", "company", "segment").agg(F.trim(body).alias("text"))
    return map_tickers(text.where("text <> ''").join(meta, ["file", "doc_no"], "left"), "company", tickers)


def compilation_stats(segments: DataFrame) -> DataFrame:
    """Distinct documents and segments of each ticker, and in all."""
    return segments.rollup("ticker").agg(F.countDistinct("doc_no").alias("n_docs"), F.count("*").alias("n_chunks")).select(F.coalesce("ticker", F.lit("TOTAL")).alias("ticker"), "n_docs", "n_chunks")


def map_tickers(df: DataFrame, name: str, mapping: dict[str, str]) -> DataFrame:
    """Ticker of a company name: as written, then in upper case, else its first word in upper case."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    upper = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.upper(), v)]) if mapping else table
    return df.withColumn("ticker", F.coalesce(F.try_element_at(table, F.col(name)), F.try_element_at(upper, F.upper(name)), F.upper(F.get(F.split(F.trim(name), " "), 0))))


def label_date(label: Column | str) -> Column:
    """The date that a label names, as written: a financial year, a day, a month with its year, else a year; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(label, p, 1), F.lit("")) for p in LABEL_DATES])


#: Headings, links, the borders of list items, and text that may hold a year.
PARTS = r"(?is)(<h[2-5][^>]*>.*?</h[2-5]|<a\s[^>]*>.*?</a\b|</?li\b|>[^<]*\d{4}[^<]*)"


def harvest_links(pages: DataFrame, base: str = "https://example.com") -> DataFrame:
    """(page_id, place, category, doc_type, name, date, url): links under the category of the heading before them.

    A heading without a known keyword clears the category. Empty, fragment and login links are dropped. A link's
    label is its text, else its title. Under calls, the latest date since the heading (of the list item as a whole,
    of text, or of a link before) names a link; elsewhere its label does, else the end of its URL. The date is that
    of the label, else that date.
    """
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PARTS), 1)).alias("place", "part"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("part", r"^>", ""), r"<[^>]+>?", " "), r"\s+", " "))
    title = F.trim(F.regexp_extract("part", r"(?is)^<a\s[^>]*?\btitle\s*=\s*[\"']([^\"']*)", 1))
    kind = F.when(F.col("part").rlike("(?i)^<h"), "head").when(F.col("part").rlike("(?i)^<a"), "link").when(F.col("part").rlike("(?i)^<li"), "item").when(F.col("part").startswith("<"), "end").otherwise("text")
    rows = rows.withColumns({"text": plain, "title": title, "kind": kind})
    page = Window.partitionBy("page_id").orderBy("place")
    rows = rows.withColumn("_item", F.count(F.when(F.col("kind").isin("head", "item", "end"), 1)).over(page))
    whole = F.array_join(F.collect_list(F.when(F.col("kind").isin("link", "text"), F.col("text"))).over(Window.partitionBy("page_id", "_item")), " ")
    rows = rows.withColumn("_own", F.when(F.col("kind") == "item", label_date(whole)).when(F.col("kind") == "head", F.coalesce(label_date("text"), F.lit(""))).otherwise(label_date("text")))
    category = F.last(F.when(F.col("kind") == "head", F.coalesce(first_match("text", CATEGORIES), F.lit(""))), ignorenulls=True).over(page)
    period = F.last("_own", ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"category": F.nullif(category, F.lit("")), "_period": F.nullif(period, F.lit(""))}).where("kind = 'link'")
    rows = rows.withColumn("_period", F.when(F.col("category") == "concalls", F.col("_period")))
    href = F.trim(F.regexp_extract("part", r"(?is)href\s*=\s*[\"']?([^\"'\s>]*)", 1))
    rows = rows.withColumn("href", href).where((F.col("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").contains("login"))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href"))
    label = F.coalesce(F.nullif("text", F.lit("")), F.col("title"))
    types = F.when(F.lower("title").contains("transcript"), "transcript")
    types = F.coalesce(first_match(label, [("transcript", "transcript")]), types, first_match(label, [("ppt", "ppt"), ("presentation", "ppt"), ("rec", "recording")]))
    types = F.coalesce(types, F.when(F.col("href").contains("youtu"), "recording").otherwise("document"))
    name = F.coalesce("_period", F.nullif(label, F.lit("")), F.element_at(F.split(url, "/"), -1))
    return rows.select("page_id", "place", "category", types.alias("doc_type"), name.alias("name"), F.coalesce(label_date(label), "_period").alias("date"), url.alias("url"))


def catalog_slices(links: DataFrame, max_presentations: int = 8) -> DataFrame:
    """Links by section, of presentations the latest only, with one running index a page."""
    w = Window.partitionBy("page_id", "section").orderBy("place")
    rows = links.withColumn("section", F.when(F.col("doc_type") == "ppt", "presentations").otherwise(F.coalesce("category", F.lit("important"))))
    kept = rows.withColumn("_k", F.row_number().over(w)).where((F.col("section") != "presentations") | (F.col("_k") <= max_presentations))
    return kept.withColumn("index_no", F.row_number().over(Window.partitionBy("page_id").orderBy("section", "place"))).select("page_id", "index_no", "section", "name", "url")


def label_year(label: Column) -> Column:
    """The latest year of a label: of four digits, else of FY notation, else of a month and two digits; null without one."""
    years = lambda p, g, base: F.array_max(F.transform(F.regexp_extract_all(F.upper(label), F.lit(p), g), lambda y: base + y.cast("int")))
    months = r"\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s*'?-?\s*([0-9]{2})\b"
    return F.coalesce(years(r"\b(19[9][0-9]|20[0-9]{2})\b", 1, 0), years(r"FY\s*-?\s*([0-9]{2})\b", 1, 2000), years(months, 2, 2000))


def archive_policy(links: DataFrame, least_year: int = 2020) -> DataFrame:
    """Links to keep: not before the year, pdf and zip files or rating pages only, the first of each URL; with a stable file name.

    A rating agency's link is a credit rating, one that says presentation or ends in pptx a presentation.
    """
    rating = reduce(lambda a, b: a | b, [F.col("url").contains(d) for d in RATING_DOMAINS])
    ext = F.lower(F.regexp_extract("url", r"(?i)\.(pdf|zip)$", 1))
    slides = F.lower("name").contains("presentation") | F.lower("url").endswith(".pptx")
    first = F.row_number().over(Window.partitionBy("url").orderBy("page_id", "place"))
    rows = links.withColumns({"_y": label_year(F.col("name")), "_rating": rating, "_ext": ext}).where(F.coalesce(F.col("_y") >= least_year, F.lit(True)) & ((F.col("_ext") != "") | F.col("_rating")))
    rows = rows.withColumn("_k", first).where("_k = 1")
    safe = F.substring(F.regexp_replace("name", r"[^A-Za-z0-9]+", "_"), 1, 200)
    file = F.concat(safe, F.lit("_"), F.substring(F.md5(F.col("url").cast("binary")), 1, 6), F.lit("."), F.when(F.col("_ext") == "", "html").otherwise(F.col("_ext")))
    category = F.when(F.col("_rating"), "credit_ratings").when(slides, "presentations").otherwise(F.coalesce("category", F.lit("important")))
    return rows.select("page_id", category.alias("category"), "name", "url", file.alias("file_name"))


def screen_universe(rows: DataFrame, min_mcap: float = 5000.0) -> DataFrame:
    """(ticker, name, sector, industry, mcap): ticker from the company's URL, the first row of each, large ones only."""
    ticker = F.regexp_extract("url", r"/company/([^/]+)/", 1)
    parsed = rows.select(ticker.alias("ticker"), "name", "sector", "industry", to_number("mcap_text").alias("mcap"), "row_no").where("ticker <> ''")
    first = parsed.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("row_no"))).where("_k = 1")
    return first.where(F.col("mcap") > min_mcap).select("ticker", "name", "sector", "industry", "mcap")


def nest_universe(universe: DataFrame) -> DataFrame:
    """One JSON text a sector: industry to its tickers, sorted."""
    lists = universe.groupBy("sector", "industry").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))
    return lists.groupBy("sector").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("industry", "tickers"))))).alias("industries"))


def latest_file(files: DataFrame) -> DataFrame:
    """Newest file of each folder."""
    return files.groupBy("folder").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def rows_to_document(rows: DataFrame, key: str, order: str, columns: list[str], title: str) -> DataFrame:
    """Rows of each key as one markdown text of type financial_data: title, header, rule, rows in order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(key).agg(body.alias("b"), F.count("*").cast("int").alias("n_rows")).select(key, F.lit("financial_data").alias("doc_type"), "n_rows", F.concat(F.lit(f"# {title} "), F.col(key).cast("string"), F.lit(f"\n{head}\n"), "b").alias("text"))


def transcript_listing(links: DataFrame, stored: DataFrame, pattern: str = r"(?i)transcript|conference call|concall") -> DataFrame:
    """Links that speak of a call, the first of each URL, without those stored. links: (ticker, name, url, place)."""
    rows = links.where(F.col("name").rlike(pattern) | F.col("url").rlike(pattern))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker", "url").orderBy("place"))).where("_k = 1")
    return first.join(stored.select("ticker", "url"), ["ticker", "url"], "left_anti").select("ticker", "name", "url", published_date("name").alias("published"))


def page_sector(pages: DataFrame, pattern: str, default: str = "General") -> DataFrame:
    """The text of a page's first link under a path, else the default."""
    found = F.trim(F.regexp_extract("html", rf"(?is)<a\s[^>]*href\s*=\s*[\"']?[^\"'>]*{pattern}[^\"'>]*[\"']?[^>]*>([^<]*)</a>", 1))
    return pages.select("page_id", F.coalesce(F.nullif(found, F.lit("")), F.lit(default)).alias("sector"))
