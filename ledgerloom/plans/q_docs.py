"""Registered queries of scans, documents, findings and events, each beside its DuckDB text where it has one."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import exprs
from ledgerloom.functions import fiscal as FI
from ledgerloom.operators import docs as D
from ledgerloom.operators import findings as J
from ledgerloom.operators import ledger as M
from ledgerloom.operators import quant as Q
from ledgerloom.operators import retrieval as V
from ledgerloom.plans.q_core import R
from ledgerloom.plans.q_ledger import _COS, _EP, _L
from ledgerloom.plans.registry import REGISTRY, query
from ledgerloom.plans.tables import VEC, oracle, relation, table
from ledgerloom.sources import scans as S
from ledgerloom.sources.shared import new_folder
from ledgerloom.sources.store import ChunkStore
from ledgerloom.streaming import events as T
from ledgerloom.streaming import jobs as B
from ledgerloom.streaming import pipelines as I
from ledgerloom.streaming import swings as W

corpus = lambda s, d: relation(s, d, "corpus").withColumn("text", F.coalesce("text", F.lit("")))
_C = oracle("corpus") + ", c as (select doc_id, ticker, coalesce(text, '') as text, lang, file_name from corpus)"
_LINES = _C + ", sp as (select doc_id, string_split(text, chr(10)) ls from c), ln0 as (select doc_id, unnest(range(0, len(ls))) line_no, unnest(ls) line from sp), ln as (select *, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as int) start from ln0)"

# --- scans -----------------------------------------------------------------------------------------


@query("s1_statement_scan", oracle("facts") + """ select ticker, statement, line_no row_no, line_item label, period period_label, cast(floor(value) as bigint) as value from facts where value is not null""")
def s1(s, d):
    """Statements written as records of their own period columns, then read back cell by cell."""
    whole = F.floor("value").cast("string")
    facts = relation(s, d, "facts").groupBy("ticker", "statement", F.col("line_no").alias("row_no"), "line_item")
    cells = F.map_from_entries(F.collect_list(F.struct("period", whole)))
    rows = facts.agg(cells.alias("c")).select("ticker", "statement", "row_no", F.map_concat(F.create_map(F.lit(""), "line_item"), "c").alias("row"))
    path = new_folder(s, "statements")
    rows.write.json(path)
    read = S.read_statements(s, path).select("ticker", "statement", "row_no", "label", F.explode("cells").alias("period_label", "raw"))
    return read.where("raw <> ''").withColumn("value", F.col("raw").cast("long")).drop("raw")


@query("s2_quarterly_csv", oracle("quarters") + " select ticker, line_item, period, cast(floor(value) as double) as value from quarters")
def s2(s, d):
    """Quarters written as one CSV file a ticker, then read back."""
    q = relation(s, d, "quarters").select("ticker", "line_item", "period", "period_no", F.floor("value").cast("string").alias("v"))
    order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period_no", c))), lambda x: x[c]), ",")
    lines = q.groupBy("ticker", "line_item").agg(order("period").alias("head"), order("v").alias("cells"))
    body = F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "line_item", "cells"))), "\n")
    texts = lines.groupBy("ticker").agg(F.concat(F.lit("Metric,"), F.max("head"), F.lit("\n"), body, F.lit("\nRaw PDF,x")).alias("value"))
    path = new_folder(s, "quarterly")
    texts.repartition("ticker").write.partitionBy("ticker").text(path)
    return S.read_quarterly_csv(s, path, r"ticker=([^/]+)/[^/]+$", "*.txt")


@query("s3_file_catalog")
def s3(s, d):
    """Files of a folder with their sizes."""
    return S.file_catalog(s, d, "*.parquet").select("filename", "size_mb")


@query("s4_new_documents", _C + " select doc_id, file_name filename from c where file_name not in (select file_name from c where doc_id % 7 = 0)")
def s4(s, d):
    """Documents whose file name the store lacks."""
    c = corpus(s, d).select("doc_id", F.col("file_name").alias("filename"))
    return S.new_documents(c, c.where("doc_id % 7 = 0")).select("doc_id", "filename")


_COMP = """k as (select n_nationkey n, n_name, 'T' || (n_regionkey + 1) meta, 'first line of ' || n_name a, 'second line' b from nation)"""


@query("s5_parse_compilation", "with " + _COMP + " select cast(n as int) doc_no, n_name company, case when n = 3 then 'THREE' else upper(string_split(n_name, ' ')[1]) end ticker, cast(sg as int) segment, case sg when 1 then a || chr(10) || b else b end as text, meta from k, (values (1), (2)) s(sg)")
def s5(s, d):
    """A text of all nations read as documents and segments."""
    n = table(s, d, "nation")
    body = F.array(
        F.concat(F.lit("# "), F.col("n_nationkey").cast("string"), F.lit(". "), "n_name"), F.concat(F.lit("* **Doc Kind**: T"), (F.col("n_regionkey") + 1).cast("string")), F.lit("---"),
        F.lit("### [Text Block] Segment 1"), F.concat(F.lit("first line of "), "n_name"), F.lit("second line"), F.lit("### [Text Block] Segment 2"), F.lit("second line"),
    )
    lines = n.select("n_nationkey", "n_regionkey", F.posexplode(body).alias("i", "line")).select(F.col("n_regionkey").alias("file"), (F.col("n_nationkey") * 100 + F.col("i")).alias("line_no"), "line")
    out = S.parse_compilation(lines, {n_name: t for n_name, t in [("NATION_3", "THREE")]}, {"Doc Kind": "doc_kind"})
    return out.select("doc_no", "company", "ticker", "segment", "text", F.element_at("metadata", "doc_kind").alias("meta"))


@query("s6_compilation_stats", "select coalesce(source, 'TOTAL') ticker, count(distinct doc_id) n_docs, count(*) n_chunks from documents group by rollup (source)")
def s6(s, d):
    """Documents and chunks of each source and in all."""
    return S.compilation_stats(table(s, d, "documents").select(F.col("source").alias("ticker"), F.col("doc_id").alias("doc_no")))


_DATE = "coalesce(" + ", ".join(f"nullif(regexp_extract(lb, '{p}', 1), '')" for p in S.LABEL_DATES) + ")"
#: The pages have no headings, so links there have neither a category nor a date from around them.
_LINKS = r"""pg as (select page_id, regexp_extract_all(html, '""" + S.PARTS + r"""') ps from pages), pu as (select page_id, unnest(range(0, len(ps))) place, unnest(ps) part from pg),
 pt as (select page_id, cast(place as int) place, part, trim(regexp_replace(regexp_replace(part, '<[^>]+>?', ' ', 'g'), '\s+', ' ', 'g')) tx, trim(regexp_extract(part, '(?is)^<a\s[^>]*?\btitle\s*=\s*["'']([^"'']*)', 1)) tt, trim(regexp_extract(part, '(?is)href\s*=\s*["'']?([^"''\s>]*)', 1)) href from pu where starts_with(lower(part), '<a')),
 pn as (select *, case when tx = '' then tt else tx end lb, case when starts_with(href, '/') then 'https://example.com' || href else href end url from pt),
 links as (select page_id, place, cast(null as varchar) category, case when contains(lower(lb), 'transcript') or contains(lower(tt), 'transcript') then 'transcript' when contains(lower(lb), 'ppt') then 'ppt' when contains(lower(lb), 'presentation') then 'ppt' when contains(lower(lb), 'rec') then 'recording' when contains(href, 'youtu') then 'recording' else 'document' end doc_type,
 case when lb = '' then string_split(url, '/')[-1] else lb end as name, """ + _DATE + r""" as "date", url from pn where href <> '' and not starts_with(href, '#') and not contains(lower(href), 'login'))"""


def _links(s, d):
    return S.harvest_links(table(s, d, "pages"))


@query("s7_harvest_links", "with " + _LINKS + " select * from links")
def s7(s, d):
    """Links of pages."""
    return _links(s, d)


@query("s8_catalog_slices", "with " + _LINKS + """, x as (select *, case when doc_type = 'ppt' then 'presentations' else coalesce(category, 'important') end section from links), k as (select *, row_number() over (partition by page_id, section order by place) n from x)
 select page_id, row_number() over (partition by page_id order by section, place) index_no, section, name, url from k where section <> 'presentations' or n <= 8""")
def s8(s, d):
    """Links by section with a running index."""
    return S.catalog_slices(_links(s, d))


def _year(pattern: str, group: int, base: int) -> str:
    return f"list_max(list_transform(regexp_extract_all(upper(name), '{pattern}', {group}), lambda y: {base} + cast(y as int)))"


_YEAR = "coalesce(" + ", ".join([
    _year(r"\b(199[0-9]|20[0-9]{2})\b", 1, 0), _year(r"FY\s*-?\s*([0-9]{2})\b", 1, 2000),
    _year(r"\b(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\s*''?-?\s*([0-9]{2})\b", 2, 2000),
]) + ")"
_RATING = " or ".join(f"contains(url, '{x}')" for x in S.RATING_DOMAINS)


@query("s9_archive_policy", "with " + _LINKS + f""", u as (select page_id, place, category, name, url || case when place % 2 = 0 then '.pdf' else '' end url from links),
 y as (select *, {_YEAR} yr, {_RATING} rating, lower(regexp_extract(url, '(?i)\\.(pdf|zip)$', 1)) ext from u), k as (select * from y where coalesce(yr >= 2020, true) and (ext <> '' or rating) qualify row_number() over (partition by url order by page_id, place) = 1)
 select page_id, case when rating then 'credit_ratings' when contains(lower(name), 'presentation') or ends_with(lower(url), '.pptx') then 'presentations' else coalesce(category, 'important') end category, name, url,
 substr(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), 1, 200) || '_' || substr(md5(url), 1, 6) || '.' || case when ext = '' then 'html' else ext end file_name from k""")
def s9(s, d):
    """Links to keep in the archive."""
    pdf = _links(s, d).withColumn("url", F.concat("url", F.when(F.col("place") % 2 == 0, ".pdf").otherwise("")))
    return S.archive_policy(pdf)


@query("s10_screen_universe", "select 'C' || c_custkey ticker, c_name as name, c_mktsegment sector, 'N' || c_nationkey industry, c_acctbal mcap from customer where c_acctbal > 5000")
def s10(s, d):
    """Large companies of a listing."""
    c = table(s, d, "customer")
    rows = c.select(F.concat(F.lit("/company/C"), F.col("c_custkey").cast("string"), F.lit("/x")).alias("url"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("industry"), F.col("c_acctbal").cast("string").alias("mcap_text"), F.col("c_custkey").alias("row_no"))
    return S.screen_universe(rows.union(rows.withColumns({"row_no": F.col("row_no") + 10**9, "mcap_text": F.lit("1")})))


@query("s11_map_tickers", "select n_nationkey, case when n_name = 'NATION_3' then 'N3' when n_name = 'NATION_4' then 'FOUR' else upper(string_split(trim(n_name), ' ')[1]) end ticker from nation")
def s11(s, d):
    """Tickers of names."""
    return S.map_tickers(table(s, d, "nation"), "n_name", {"NATION_3": "N3", "nation_4": "FOUR"}).select("n_nationkey", "ticker")


@query("s12_latest_file", "select user_id folder, max_by('f' || event_id, (ts, 'f' || event_id)) path, max(ts) modified from events group by 1")
def s12(s, d):
    """Newest file of each folder."""
    return S.latest_file(table(s, d, "events").select(F.col("user_id").alias("folder"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("modified")))


@query("s13_rows_to_document", """select s_nationkey, 'financial_data' doc_type, count(*) n_rows, '# Suppliers ' || s_nationkey || chr(10) || '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) order by s_suppkey) as text from supplier group by 1""")
def s13(s, d):
    """Rows as one markdown text a key."""
    return S.rows_to_document(table(s, d, "supplier"), "s_nationkey", "s_suppkey", ["s_suppkey", "s_name"], "Suppliers")


_SPEAKS = r"(?i)transcript|conference call|concall"


@query("s14_transcript_listing", "with " + _LINKS + rf""", n as (select 'P' || page_id % 5 ticker, case when page_id % 3 = 0 then 'Transcript of 2024-05-1' || place % 10 else regexp_replace(name, '[0-9]', '', 'g') end as name, url, place, page_id from links),
 f as (select * from n where regexp_matches(name, '{_SPEAKS}') or regexp_matches(url, '{_SPEAKS}') qualify row_number() over (partition by ticker, url order by page_id * 1000 + place) = 1)
 select ticker, name, url, try_cast(nullif(regexp_extract(name, '[0-9-]+$'), '') as date) published from f where not (ticker = 'P1')""")
def s14(s, d):
    """Links that speak of a call and are not stored, with their dates."""
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Transcript of 2024-05-1"), (F.col("place") % 10).cast("string"))).otherwise(F.regexp_replace("name", "[0-9]", ""))
    ticker = F.concat(F.lit("P"), (F.col("page_id") % 5).cast("string"))
    rows = _links(s, d).select(ticker.alias("ticker"), name.alias("name"), "url", (F.col("page_id") * 1000 + F.col("place")).alias("place"))
    return S.transcript_listing(rows, rows.where("ticker = 'P1'"))


@query("s15_page_sector", r"""select page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<a\s[^>]*href\s*=\s*["'']?[^"''>]*/[^"''>]*["'']?[^>]*>([^<]*)</a>', 1)), ''), 'General') sector from pages""")
def s15(s, d):
    """The text of the first link under a path."""
    return S.page_sector(table(s, d, "pages"), "/")


# --- documents -------------------------------------------------------------------------------------

_BEST = "greatest(" + ", ".join(D.DOC_TYPES) + ")"
_HITS = ", ".join(" + ".join("cast(regexp_matches(t, '" + p.replace("'", "''") + "') as int)" for p in ps) + f" {t}" for t, ps in D.DOC_TYPES.items())


@query("d1_classify", _C + f", h as (select doc_id, substr(text, 1, 5000) t from c), x as (select doc_id, {_HITS} from h) select doc_id, case when {_BEST} = 0 then 'other' " + " ".join(f"when {t} = {_BEST} then '{t}'" for t in D.DOC_TYPES) + " end doc_type from x")
def d1(s, d):
    """Types of documents."""
    return corpus(s, d).select("doc_id", D.classify_documents(F.col("text")).alias("doc_type"))


#: The headings of the library, and one kind that the texts hold.
_HEADS = [*D.HEADINGS, r"^((?:The|Of|Ing)[a-z]*) "]
_TITLE = "coalesce(" + ", ".join("case when regexp_matches(t, '{0}') then coalesce(nullif(trim(regexp_extract(t, '{0}', 1)), ''), t) end".format(p.replace("'", "''")) for p in _HEADS) + ")"


@query("d2_split_sections", _LINES + f""", h as (select doc_id, start, {_TITLE} title from (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') t from ln)),
 k as (select * from h where title is not null union all select doc_id, 0, 'Introduction' from h group by doc_id having not bool_or(start = 0 and title is not null)),
 w as (select *, cast(row_number() over (partition by doc_id order by start) - 1 as int) section_no, lead(start) over (partition by doc_id order by start) stop from k)
 select w.doc_id, section_no, title, start, substr(text, start + 1, coalesce(stop, length(text)) - start) as text from w join c using (doc_id) where regexp_matches(substr(text, start + 1, coalesce(stop, length(text)) - start), '\\S')""")
def d2(s, d):
    """Sections by headings."""
    return D.split_sections(corpus(s, d), _HEADS)


#: Texts with tables: bars, tabs and columns in place of some words.
_TABLED = "replace(replace(replace(replace({0}, '. ', concat('.', {1})), ' | ', concat({1}, '| ')), ' of ', {2}), ' de ', '   12.5 ')"


@query("d3_table_blocks", _LINES.replace("coalesce(text, '') as text", _TABLED.format("coalesce(text, '')", "chr(10)", "chr(9)") + " as text") + f""", m as (select *, line_no - row_number() over (partition by doc_id order by line_no) i from ln where regexp_matches(line, '{D.TABLE_LINE_SQL}')),
 r as (select m.doc_id, i, min(start) start, max(start + length(line) + 1) "end", cast(count(*) as int) n_lines from m group by 1, 2)
 select doc_id, start, "end", n_lines from r join c using (doc_id) where n_lines - case when "end" > length(text) then 1 else 0 end >= 2""")
def d3(s, d):
    """Tables in texts."""
    return D.table_blocks(corpus(s, d).withColumn("text", F.expr(_TABLED.format("text", "char(10)", "char(9)"))))


def _cut(s, d):
    """Documents with their period, and their sections cut into chunks."""
    kind = F.when(F.col("doc_id") % 2 == 0, "annual_report").otherwise("note")
    docs = corpus(s, d).withColumns({"text": F.expr(_TABLED.format("text", "char(10)", "char(9)")), "doc_type": kind})
    docs = docs.select("*", F.inline(F.array(FI.stamp_period("file_name", "text"))))
    return docs, D.chunk_text(D.split_sections(docs, _HEADS).join(docs.select("doc_id", "doc_type"), "doc_id"))


@query("d4_chunk_text")
def d4(s, d):
    """Overlapping chunks of the sections of whole texts."""
    return _cut(s, d)[1].select("doc_id", "section_no", "chunk_no", "start", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("d5_chunk_records")
def d5(s, d):
    """Chunks with identifiers and totals."""
    docs, chunks = _cut(s, d)
    return D.chunk_records(chunks, docs).select("doc_id", "chunk_id", "section_no", "title", "chunk_no", "section_chunks", "n_chars", F.md5(F.col("text").cast("binary")).alias("md5"))


_HAS = lambda ws: "(" + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + ")"


@query("d6_table_pages", _C + r""", l as (select doc_id, text, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) ls from c),
 x as (select doc_id, text, len(ls) n, len(list_filter(ls, lambda x: regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[,.()-]*[0-9][0-9,.()-]*$'))) / cast(len(ls) as double) share from l)""" + f"""
 select doc_id, {R("share", 4)} share, n >= 5 and (share > 0.25 or (share > 0.15 and {_HAS(D.STATEMENT_WORDS)}) or (share > 0.08 and {_HAS(D.DISCLOSURE_WORDS)})) is_table from x""")
def d6(s, d):
    """Pages that are tables."""
    share, is_table = D.table_pages(F.col("text"))
    return corpus(s, d).select("doc_id", share.alias("share"), is_table.alias("is_table"))


#: Texts of calls: some with a heading of the questions, some with speakers alone.
_TALKED = "concat({0}, {1}, case doc_id % 5 when 0 then 'now Q & A' when 1 then 'the Interactive  Session' when 2 then 'A Participant: why' when 3 then concat('the moderator - x', {1}, 'Analyst Questions and answers') else 'end' end, {1}, {0})"
_STARTS = ", ".join(f"case when regexp_matches(t, '{p}') then length(regexp_extract(t, '(?s)^(.*?){p}', 1)) + 1 end" for p in D.QA_HEADINGS)


@query("d7_qa_section", _C + f""", x as (select doc_id, {_TALKED.format("text", "chr(10)")} t from c), y as (select doc_id, t, coalesce({_STARTS}) a, string_split(t, chr(10)) ls from x),
 z as (select *, list_position(list_transform(ls, lambda l: regexp_matches(l, '{D.QA_SPEAKER}')), true) p from y)
 select doc_id, case when a is not null then substr(t, a) when p > 0 then array_to_string(ls[p:], chr(10)) end qa from z""")
def d7(s, d):
    """Texts from their questions on."""
    return corpus(s, d).select("doc_id", D.qa_section(F.expr(_TALKED.format("text", "char(10)"))).alias("qa"))


_PAT = [p for ps in D.RISKS.values() for p in ps] + ["tion ", "the [a-z]+"]
_COUNT = lambda ps: " + ".join("len(regexp_extract_all(text, '" + p.replace("'", "''") + "'))" for p in ps)


@query("d8_kwic", _C + f", k as (select doc_id, cast({_COUNT(_PAT)} as bigint) n from c) select * from k where n > 0")
def d8(s, d):
    """Matches of the library's risk patterns, and of two that the texts hold, with their context, counted."""
    return D.kwic(corpus(s, d), _PAT, 200, 300).groupBy("doc_id").agg(F.count("*").alias("n"))


_OWN_TEXT = lambda p: "'" + p.replace("'", "''") + "'"
#: Texts that name a risk of each family.
_RISKY = "concat({0}, case doc_id % 5 when 0 then ' Contingent  liabilities ' when 1 then ' related party transactions ' when 2 then ' Emphasis of matter ' when 3 then ' pledge of shares ' else ' none ' end, {0})"
_FAMILY = " union all ".join(f"select doc_id, '{k}' family, unnest(regexp_extract_all(t, {_OWN_TEXT(p)})) m from x" for k, ps in D.RISKS.items() for p in ps)


@query("d8_risk_contexts", _C + f", x as (select doc_id, {_RISKY.format('text')} t from c), y as ({_FAMILY}) select doc_id, family, count(*) n, cast(sum(length(m)) as bigint) letters from y group by 1, 2")
def d8_families(s, d):
    """Matches of each family of risks with the family's context, counted."""
    found = D.risk_contexts(corpus(s, d).withColumn("text", F.expr(_RISKY.format("text"))))
    held = F.col("context").contains(F.trim("match"))
    return found.where(held).groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.sum(F.length("match")).alias("letters"))


_CELLS = ", ".join(f"cast({_COUNT(ps)} as int) n_{k}, {_COUNT(ps)} > 0 has_{k}" for k, ps in D.RISKS.items())


@query("d9_risk_signals", _C + f" select doc_id, {_CELLS}, {_COUNT(D.RISKS['audit_red_flags'])} > 0 and regexp_matches(text, '{D.AUDITOR_CHANGE}') auditor_changed from c where trim(text) <> ''")
def d9(s, d):
    """Signals of each document."""
    return D.risk_signals(corpus(s, d))


talk = lambda s, d: relation(s, d, "talk").withColumns({"text": F.coalesce("text", F.lit("")), "doc_id": F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))})
#: The library's phrases, and four that the turns hold; the sectors of conversations.
_PH = [*D.hedges_of(), ("the", None), ("tion", None), ("ing", "fmcg"), ("and", None)]
_NAMES = ["FMCG - Personal Care", "Private Sector Bank", "IT - Software", "Pharmaceuticals", "Metals"]
_SECTOR = "case conv_id % 5 " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(_NAMES)) + " end"
_KEY = "case " + " ".join(f"when contains(lower(sector), '{w}') then '{k}'" for w, k in D.SECTORS) + " else 'general' end"
_VALUES = ", ".join("({}, '{}', {})".format(k, p.lower().replace("'", "''"), "null" if x is None else f"'{x}'") for k, (p, x) in enumerate(_PH))
_HED = oracle("talk") + f""", t as (select *, {_KEY} key from (select conv_id || '-' || turn doc_id, lower(coalesce(text, '')) as text, {_SECTOR} sector from talk)), ph(k, phrase, so) as (values {_VALUES}),
 h as (select doc_id, phrase, so is not null sector_only, cast((length(text) - length(replace(text, phrase, ''))) / length(phrase) as int) n, k from t, ph where so is null or so = key),
 g as (select *, cast(sum(n) over (partition by doc_id) as int) total, row_number() over (partition by doc_id order by n desc, k) place from h where n > 0)"""


def _sectors(s, d):
    return talk(s, d).withColumn("sector", F.expr(_SECTOR))


@query("d10_hedging", _HED + " select doc_id, phrase, sector_only, n, total, place from g where place <= 15")
def d10(s, d):
    """Hedges of each turn."""
    return D.hedging(_sectors(s, d), _PH, sector_col="sector").select("doc_id", "phrase", "sector_only", "n", "total", "place")


_CALL = oracle("talk") + """, t as (select conv_id || '-' || turn doc_id, 'We expect ' || x || ' growth in FY25, with a target. Could you say what is ' || x || '? ' || x as text from (select *, replace(coalesce(text, ''), chr(10), ' ') x from talk))"""
_OWN = lambda p: "'" + p.replace("'", "''") + "'"


def _call(s, d):
    """Turns as parts of a call: guidance, a question, then the turn."""
    x = F.replace("text", F.lit("\n"), F.lit(" "))
    return talk(s, d).withColumn("text", F.concat(F.lit("We expect "), x, F.lit(" growth in FY25, with a target. Could you say what is "), x, F.lit("? "), x))


@query("d11_guidance", _CALL + ", m as (" + " union all ".join(f"select doc_id, {k} pattern_no, regexp_extract_all(text, {_OWN(p)}) ms from t" for k, p in enumerate(D.GUIDANCE)) + """), u as (select doc_id, pattern_no, unnest(range(0, len(ms))) i, unnest(ms) "match" from m),
 n as (select *, row_number() over (partition by doc_id order by pattern_no, i) place from u) select doc_id, pattern_no, place, "match" from n where place <= 10""")
def d11(s, d):
    """The first passages of guidance."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pattern_no", "start"))
    return D.guidance(_call(s, d)).select("doc_id", "pattern_no", place.alias("place"), "match")


@query("d12_analyst_questions", _CALL + f""", m as (select doc_id, regexp_extract_all(text, {_OWN(D.QUESTION)}) ms from t), u as (select doc_id, unnest(range(1, len(ms) + 1)) place, unnest(ms) "match" from m) select doc_id, cast(place as int) place, "match" from u where place <= 10""")
def d12(s, d):
    """The first questions of each turn."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))
    return D.analyst_questions(_call(s, d)).select("doc_id", place.alias("place"), "match")


@query("d13_candour", _HED + " select doc_id, greatest(10, 80 - 5 * max(total)) score, string_agg(phrase, ',' order by place) filter (where place <= 5) key_phrases from g group by 1")
def d13(s, d):
    """Candour of each turn."""
    return D.candour_score(D.hedging(_sectors(s, d), _PH, sector_col="sector"))


@query("d14_rank_passages", _C + """, sp as (select doc_id, string_split(text, chr(10)) ls from c), p as (select doc_id, cast(unnest(range(0, len(ls))) as int) place, unnest(ls) p from sp), q as (select *, cast((length(lower(p)) - length(replace(lower(p), 'the', ''))) / 3 + (length(lower(p)) - length(replace(lower(p), 'tion', ''))) / 4 as int) + case when contains(lower(p), 'the tion') then 10 else 0 end score from p where length(p) >= 30),
 b as (select *, row_number() over (partition by doc_id order by score desc, place) rank from q where score > 0 qualify rank <= 3) select c.doc_id, coalesce(rank, 1) rank, place, coalesce(score, 0) score, coalesce(substr(p, 1, 1000), 'NO MATCHING PASSAGE') passage from c left join b using (doc_id)""")
def d14(s, d):
    """Paragraphs that fit a query best."""
    return D.rank_passages(corpus(s, d), "the tion", 3, parting=r"\n")


#: Texts with notes in three spellings, and what is asked for.
_NOTED = "concat({0}, case doc_id % 4 when 0 then ' see Note 42.' when 1 then ' see note NO. 42' when 2 then ' Notes 42' else '' end, {0})"


@query("d15_page_snippet", _C + f""", x as (select doc_id, {_NOTED.format("text")} t from c), y as (select *, coalesce(nullif(position('note 42' in lower(t)), 0), nullif(position('note no. 42' in lower(t)), 0), nullif(position('notes 42' in lower(t)), 0)) a from x)
 select doc_id, coalesce(substr(t, greatest(a - 200, 1), a - greatest(a - 200, 1) + 3000), chr(39) || ' Note 42' || chr(39) || ' not found in document.') as content, a is not null as found, cast(a - 1 as int) as "position" from y""")
def d15(s, d):
    """Text around a reference."""
    rows = corpus(s, d).select("doc_id", D.page_snippet(F.expr(_NOTED.format("text")), F.lit(" Note 42")).alias("r"))
    return rows.select("doc_id", "r.content", "r.found", "r.position")


#: Texts that state growth and shares in several ways.
_GROWN = """concat(text, case doc_id % 4 when 0 then ' Underlying volume growth was ' when 1 then ' volumes grew by ' when 2 then ' volume decline of about ' else ' volume ' end, cast(doc_id % 37 as {0}), '.5 % and ',
 case doc_id % 3 when 0 then 'price/mix growth of ' when 1 then 'Pricing contributed ' else 'price ' end, cast(doc_id % 11 as {0}), '%; ',
 case doc_id % 5 when 0 then concat('rural share stood at ', cast(doc_id % 90 as {0}), '.25%') when 1 then concat('Rural:Urban split of ', cast(doc_id % 60 as {0}), ':', cast(60 - doc_id % 60 as {0}), ' and rural demand contributed 9%') else ' no more' end)"""
_NUMBER = lambda ps, k=1: "try_cast(coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', {k}), '')" for p in ps) + ") as double)"


@query("d16_growth_split", _C + f""", x as (select doc_id, {_GROWN.format("varchar")} t from c), y as (select doc_id, {_NUMBER(D.VOLUME_PATTERNS)} v, {_NUMBER(D.PRICE_PATTERNS)} p, {_NUMBER(D.RURAL_PATTERNS)} r,
 case when not regexp_matches(t, '{D.RURAL_PATTERNS[0]}') then {_NUMBER(D.RURAL_PATTERNS[1:2], 2)} end u from x)
 select doc_id, v volume_pct, p price_pct, r rural_pct, coalesce(u, {R("100 - r", 1)}) urban_pct, concat_ws(' | ', 'Volume growth: ' || v || '%', 'Price/Mix growth: ' || p || '%') summary,
 cast(case when v is null and p is null then 1 else 0 end + case when r is null then 1 else 0 end as int) n_gaps from y""")
def d16(s, d):
    """Growth and shares that texts state."""
    out = D.growth_split(corpus(s, d).withColumn("text", F.expr(_GROWN.format("string"))))
    return out.withColumn("n_gaps", F.size("gaps")).drop("gaps")


def _payloads(s, d):
    e = table(s, d, "events")
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"segments":[{"name":"seg'), k, F.lit('","revenue":'), k, F.lit(',"margin":0.5}],"gaps":["g'), k, F.lit('"]}'))
    return e.select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("ticker"), F.when(F.col("event_id") % 30 == 0, "{broken").otherwise(good).alias("payload"), k.alias("k"))


@query("d17_segments", "with e as (select 'E' || event_id t, event_id, json_extract_string(props, '$.k') k from events) select t ticker, 'segment' kind, 'seg' || k as name, cast(k as double) revenue, 0.5e0 margin from e where event_id % 30 <> 0 union all select t, 'gap', case when event_id % 30 = 0 then 'bad payload' else 'g' || k end, null, null from e")
def d17(s, d):
    """Segments from payloads."""
    return D.segments_from_payload(_payloads(s, d))


@query("d18_dedupe_lines", _LINES + r""", k as (select *, case when starts_with(regexp_replace(line, '^\s+', ''), '#') then '' else lower(regexp_replace(regexp_replace(line, '^[\s*•\d.-]+', ''), '^\s+|\s+$', '', 'g')) end key from ln),
 f as (select *, row_number() over (partition by doc_id, key order by line_no) n from k) select doc_id, string_agg(line, chr(10) order by line_no) as text from f where n = 1 or key = '' group by 1""")
def d18(s, d):
    """Texts without repeated lines."""
    return D.dedupe_lines(corpus(s, d))


#: Reports: texts with phrases that must not stand in one.
_REPORT = "concat(', The forensic_quant agent flags ', text, case doc_id % 3 when 0 then ' our moat analysis shows that cash is good' when 1 then ' US generics account for 12% of sales. U.S. OTC represents about 45% of total revenue' else ' growth is slowing; it contradicts' end, ',  ', {0}, '   ', {0}, ' , as per our capital review, ', text)"


def _report_sql() -> str:
    out = _REPORT.format("chr(10)")
    for pattern, text in D.REPORT_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{text}', 'g')"
    out = rf"regexp_replace({out}, '(?s)^(.*?)({D.SHARE_CLAIM})', '\1\2{D.SHARE_NOTE}')"
    for pattern, text in D.TIDY:
        out = f"regexp_replace({out}, '{pattern}', '{text}', 'g')"
    return out


@query("d19_rewrite", _C + f" select doc_id, {_report_sql()} as text from c")
def d19(s, d):
    """Reports after their rules."""
    return corpus(s, d).select("doc_id", D.rewrite(F.expr(_REPORT.format("char(10)"))).alias("text"))


@query("d20_truncate", _C + f" select doc_id, md5(substr(text, 1, 900)) head_md5, coalesce({R('greatest(length(text) - 900, 0) * 100.0e0 / nullif(length(text), 0)', 1)}, 0) lost_pct from c")
def d20(s, d):
    """Texts cut, with what was lost."""
    head, lost = D.truncate_with_gap(F.col("text"), 900)
    return corpus(s, d).select("doc_id", F.md5(head.cast("binary")).alias("head_md5"), lost.alias("lost_pct"))


@query("d21_dodge_rate", "with a as (select user_id, " + R("avg(case when event_type in ('error', 'view') then 1.0e0 else 0e0 end)", 2) + " r from events group by 1) select user_id, r dodge_rate, r > 0.30 high, " + R("1 - r", 2) + " candour from a")
def d21(s, d):
    """Rates of evasive labels."""
    return D.dodge_rate(table(s, d, "events").select("user_id", F.col("event_type").alias("label")), "user_id", ("error", "view"))


@query("d22_claim_verdicts", "with e as (select 'E' || event_id t, event_id, json_extract_string(props, '$.k') k from events) select t ticker, case when event_id % 30 = 0 then 'UNKNOWN' else 'HIGH' end strength, case when event_id % 30 <> 0 then 'c' || k end claim, 'UNKNOWN' as type, case when event_id % 30 <> 0 then 'TRUE' else 'UNVERIFIABLE' end verdict, cast(null as varchar) evidence, 0.0e0 confidence from e")
def d22(s, d):
    """Claims from payloads."""
    p = _payloads(s, d)
    good = F.concat(F.lit('{"strength":"HIGH","claims":[{"claim":"c'), "k", F.lit('","verdict":"TRUE"}]}'))
    return D.claim_verdicts(p.withColumn("payload", F.when(F.col("payload").startswith("{broken"), "{broken").otherwise(good)))


@query("d23_recent_turns", oracle("talk") + """, k as (select * from talk qualify row_number() over (partition by conv_id order by turn desc) <= 6), l as (select conv_id, turn, upper(role) || ': ' || case when length(text) > 500 then substr(text, 1, 500) || '...' else text end l from k where trim(coalesce(text, '')) <> '')
 select conv_id, string_agg(l, chr(10) order by turn, l) history, count(*) n_turns from l group by 1""")
def d23(s, d):
    """The last turns of each conversation."""
    return D.recent_turns(relation(s, d, "talk"))


@query("d24_page_text", r"""with a as (select page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') t from pages), b as (select page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]+>', ' ', 'g') t from a)
 select page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as text from b""")
def d24(s, d):
    """Letters of pages."""
    return table(s, d, "pages").select("page_id", D.page_text(F.col("html")).alias("text"))


# --- findings --------------------------------------------------------------------------------------


@query("j1_parse_payloads", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events where event_id % 7 <> 0")
def j1(s, d):
    """Payloads with thoughts and fences, read; broken ones apart."""
    raw = F.when(F.col("event_id") % 7 == 0, "{oops").otherwise(F.concat(F.lit("<think>no {x}</think>```json\n"), "props", F.lit("\n```")))
    good, _ = J.parse_payloads(table(s, d, "events").select("event_id", raw.alias("payload")))
    return good.select("event_id", F.try_variant_get("parsed", "$.k", "bigint").alias("k"))


def _findings(s, d):
    e = table(s, d, "events")
    k, year = F.get_json_object("props", "$.k"), (F.col("event_id") % 4).cast("string")
    body = F.concat(
        F.lit('{"a":{"x":'), k, F.lit(',"Evidence_text":"q","deep":{"p":1,"q":2}},"one":{"x":1},"links":[{"cause_date":"FY2'), year,
        F.lit('","effect_date":"FY22"},{"y":1,"z":{"w":[[{"cause_date":"FY2'), year, F.lit('","effect_date":"FY21"}]]}}]}'),
    )
    return e.select("event_id", F.try_parse_json(body).alias("parsed"), F.lit(1.0).alias("completeness"), (F.col("event_id") % 3).cast("int").alias("errors"))


@query("j2_grounding", "select event_id, 1 n_grounded, 3 n_findings, " + R("greatest(0, least(1, 0.6e0 + 0.4e0 / 3 - least(0.1e0 * (event_id % 3), 0.2e0)))", 2) + """ confidence,
 case when event_id % 5 = 0 then 'Missing required input: quarters; ' else '' end || 'Missing evidence for 2 finding(s)' || case when event_id % 3 > 0 then '; Critical error: E' || event_id else '' end reasons from events""")
def j2(s, d):
    """Confidence by what is grounded, and why."""
    missing = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("quarters")))
    critical = F.when(F.col("event_id") % 3 > 0, F.array(F.concat(F.lit("E"), F.col("event_id").cast("string"))))
    out = J.grounding(_findings(s, d).withColumns({"missing": missing, "critical": critical}), "event_id")
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@query("j3_chronology_scan", """select event_id, event_id % 4 < 2 accepted, case event_id % 4 when 3 then '$.links[0000]' when 2 then '$.links[0001].z.w[0000][0000]' end path,
 case event_id % 4 when 3 then 2 when 2 then 1 else 0 end n_violations from events""")
def j3(s, d):
    """The first effect before its cause."""
    return J.chronology_scan(_findings(s, d), "event_id")


_GONE = '{"removed_by_auditor":"Causal claim removed: failed chronological verification."}'


@query("j4_scrub", f"""with y as (select event_id, cast(event_id % 4 as varchar) y from events) select event_id,
 '{{"a":{{"n":1,"deep":[[' || case when y = '3' then '{_GONE}' else '{{"cause_date":"FY2' || y || '","effect_date":"FY22","claim":"c"}}' end || ']]}},"links":[' ||
 case when y in ('2', '3') then '{_GONE}' else '{{"cause_date":"FY2' || y || '","effect_date":"FY21","inner":{{"cause_date":"FY23","effect_date":"FY25"}}}}' end || ']}}' payload,
 case y when '3' then 'FY23 -> FY22; FY23 -> FY21' when '2' then 'FY22 -> FY21' else '' end removed from y""")
def j4(s, d):
    """Claims against time removed from nested findings, at three depths."""
    year = (F.col("event_id") % 4).cast("string")
    body = F.concat(
        F.lit('{"a":{"n":1,"deep":[[{"cause_date":"FY2'), year, F.lit('","effect_date":"FY22","claim":"c"}]]},"links":[{"cause_date":"FY2'), year,
        F.lit('","effect_date":"FY21","inner":{"cause_date":"FY23","effect_date":"FY25"}}]}'),
    )
    return J.scrub(table(s, d, "events").select("event_id", body.alias("payload"))).withColumn("removed", F.array_join("removed", "; "))


@query("j5_apply_corrections", oracle("talk") + " select conv_id || '-' || turn doc_id, case when turn % 2 = 0 then replace(replace(coalesce(text, ''), 'the', 'THE'), 'THE', 'A') else coalesce(text, '') end as text, case when turn % 2 = 0 then 2 else 0 end n_corrections from talk")
def j5(s, d):
    """Wrong claims replaced in order."""
    t = talk(s, d)
    c = t.where("turn % 2 = 0").select("doc_id", F.inline(F.array(F.struct(F.lit(1).alias("place"), F.lit("the").alias("wrong"), F.lit("THE").alias("right")), F.struct(F.lit(2).alias("place"), F.lit("THE").alias("wrong"), F.lit("A").alias("right")))))
    return J.apply_corrections(t.select("doc_id", "text"), c, "doc_id")


_AG = """with l as (select user_id, max(value) / 500 q, case when bool_or(event_type = 'error') then 'HIGH' else 'LOW' end sev, case when user_id % 2 = 0 then 'Strong' else 'WEAK' end moat,
 case when user_id % 3 = 0 then 'a Cautious outlook' else 'calm' end tone, count(*) n from events group by 1)"""


def _agents(s, d):
    e = table(s, d, "events").groupBy("user_id").agg((F.max("value") / 500).alias("cash_quality"), F.max((F.col("event_type") == "error").cast("int")).alias("sev"), F.count("*").alias("n"))
    tone = F.when(F.col("user_id") % 3 == 0, "a Cautious outlook").otherwise("calm")
    return e.select(
        F.col("user_id").alias("ticker"), "cash_quality", F.array(F.lit("LOW"), F.when(F.col("sev") == 1, "HIGH")).alias("severities"),
        F.when(F.col("user_id") % 2 == 0, "Strong").otherwise("WEAK").alias("moat"), F.array(F.lit("steady"), tone).alias("tones"), "n",
    )


@query("j6_conflicts", _AG + """, c as (select user_id, list_filter([case when q > 0.8 and sev = 'HIGH' then 'forensic_quant, forensic_investigator: strong cash quality against severe flags' end,
 case when moat = 'Strong' and contains(tone, 'Cautious') then 'moat_architect, narrative_decoder: intact moat against a worsening tone' end], lambda x: x is not null) f from l)
 select user_id ticker, coalesce(array_to_string(f, '; '), '') conflicts, len(f) n_conflicts from c""")
def j6(s, d):
    """Findings that contradict each other."""
    return J.conflicts(_agents(s, d))


@query("j7_rerun_needs", _AG + """ select user_id ticker, coalesce(array_to_string(list_filter([case when sev = 'HIGH' then 'forensic_quant' end, case when user_id % 3 = 0 then 'narrative_decoder' end,
 case when n % 5 >= 3 then 'forensic_investigator' end], lambda x: x is not null), ','), '') rerun from l""")
def j7(s, d):
    """Agents to run again."""
    a = _agents(s, d)
    return J.rerun_needs(a.select("ticker", "severities", (F.col("ticker") % 3 == 0).alias("unrelated_acquisitions"), (F.col("n") % 5).alias("n_governance_flags")))


_EV = """with i as (select user_id * 100000 + event_id % 20000 ticker, case event_type when 'click' then 'guidance' when 'view' then 'shift' when 'error' then 'dodge' else 'phrase' end kind,
 case event_id % 3 when 0 then 'low' when 1 then 'MEDIUM-TERM' else 'HIGH' end lv from events),
 p as (select ticker, count(*) filter (where kind = 'guidance' and lv <> 'HIGH') g, count(*) filter (where kind = 'shift' and lv <> 'low') s, count(*) filter (where kind = 'dodge') d, count(*) filter (where kind = 'phrase') h,
 sum(case kind when 'guidance' then case lv when 'low' then 15 when 'MEDIUM-TERM' then 7 else 0 end when 'shift' then case lv when 'HIGH' then 10 when 'MEDIUM-TERM' then 5 else 0 end when 'dodge' then 8 else 3 end) pts from i group by 1)"""


@query("j8_evasion_score", _EV + """, z as (select *, greatest(0, least(100, 10 + pts)) score from p)
 select ticker, g guidance_misses, s tone_shifts, d analyst_dodges, h flagged_phrases, score, case when score >= 75 then 'HIGH EVASION — Management is likely deflecting on critical issues'
 when score >= 45 then 'MODERATE EVASION — Some hedging detected, selective transparency' when score >= 25 then 'LOW EVASION — Minor hedging, mostly transparent communication' else 'TRANSPARENT — Management communication appears forthcoming' end verdict from z""")
def j8(s, d):
    """Evasion of each ticker."""
    kind = F.when(F.col("event_type") == "click", "guidance").when(F.col("event_type") == "view", "shift").when(F.col("event_type") == "error", "dodge").otherwise("phrase")
    lv = F.when(F.col("event_id") % 3 == 0, "low").when(F.col("event_id") % 3 == 1, "MEDIUM-TERM").otherwise("HIGH")
    return J.evasion_score(table(s, d, "events").select((F.col("user_id") * 100000 + F.col("event_id") % 20000).alias("ticker"), kind.alias("kind"), lv.alias("level")))


@query("j9_flag_triage", """with f as (select user_id ticker, event_id no, upper(event_type) fam, case when event_id % 50 = 0 then 'High' when event_id % 7 <> 0 then 'LOW' end sv, 't' || (event_id % 4) tx from events)
 select ticker, not bool_or(coalesce(sv = 'High', false)) passed, coalesce(string_agg(fam || ': ' || tx, '; ' order by no) filter (where sv = 'High'), '') kill_reasons,
 coalesce(string_agg(fam || ': ' || tx, '; ' order by no) filter (where sv is distinct from 'High'), '') warnings from f group by 1""")
def j9(s, d):
    """Severe flags fail, others warn."""
    e = table(s, d, "events")
    severity = F.when(F.col("event_id") % 50 == 0, "High").when(F.col("event_id") % 7 != 0, "LOW")
    return J.flag_triage(e.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("place"), F.col("event_type").alias("family"), severity.alias("severity"), F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")).alias("text")))


@query("j10_ordered_summary", """with t as (select distinct user_id ticker, case event_type when 'view' then 'pm_synthesis' when 'click' then 'critic_agent' when 'error' then 'forensic_quant' else event_type end agent from events)
 select ticker, agent, row_number() over (partition by ticker order by case agent when 'forensic_quant' then 0 when 'critic_agent' then 1 when 'pm_synthesis' then 2 else 3 end, agent) place from t""")
def j10(s, d):
    """Agents in their fixed order."""
    agent = F.when(F.col("event_type") == "view", "pm_synthesis").when(F.col("event_type") == "click", "critic_agent").when(F.col("event_type") == "error", "forensic_quant").otherwise(F.col("event_type"))
    return J.ordered_summary(table(s, d, "events").select(F.col("user_id").alias("ticker"), agent.alias("agent")).distinct())


@query("j10_trails_summary", """with t as (select distinct user_id ticker, case event_type when 'view' then 'pm_synthesis' when 'click' then 'critic_agent' when 'error' then 'forensic_quant' else event_type end agent from events)
 select ticker, array_to_string(list(agent order by case agent when 'forensic_quant' then 0 when 'critic_agent' then 1 when 'pm_synthesis' then 2 else 3 end, agent), ',') agents, count(*) n,
 case when bool_or(agent = 'pm_synthesis') then 'BUY ' || ticker end recommendation, case when bool_or(agent = 'pm_synthesis') then 'cash,moat' else '' end positives, '' negatives from t group by 1""")
def j10_summary(s, d):
    """One row a ticker: its agents in order and the verdict."""
    agent = F.when(F.col("event_type") == "view", "pm_synthesis").when(F.col("event_type") == "click", "critic_agent").when(F.col("event_type") == "error", "forensic_quant").otherwise(F.col("event_type"))
    trails = table(s, d, "events").select(F.col("user_id").alias("ticker"), agent.alias("agent")).distinct()
    pm = F.concat(F.lit('{"recommendation":"BUY '), F.col("ticker").cast("string"), F.lit('","bull_case":["cash","moat"],"bear_case":null}'))
    filled = {"confidence": F.lit(0.5), "reasons": F.lit(None).cast("array<string>"), "findings": F.when(F.col("agent") == "pm_synthesis", pm), "seconds": F.lit(1.0)}
    out = J.trails_summary(trails.withColumns(filled))
    joined = lambda c: F.array_join(F.col("verdict")[c], ",").alias(c)
    names = F.array_join(F.transform("trails", lambda t: t["agent"]), ",").alias("agents")
    return out.select("ticker", names, F.size("trails").cast("long").alias("n"), F.col("verdict.recommendation").alias("recommendation"), joined("positives"), joined("negatives"))


@query("j11_render_citations", """select event_id, 'Roic Trend: up; Net PAT: ' || event_id || '; Citations: "s' || event_id || '" — d, p.' || (event_id % 9) || ' • — e • x; Deep: Bull Case: 1.5 • A B: True' as cited from events""".replace("Roic", "ROIC"))
def j11(s, d):
    """Nested findings as one line."""
    i = F.col("event_id").cast("string")
    body = F.concat(
        F.lit('{"roic_trend":"up","empty":[],"net_pat":'), i, F.lit(',"no":"None","citations":[{"snippet":" s'), i, F.lit('","doc_id":"d","page":'), (F.col("event_id") % 9).cast("string"),
        F.lit('},{"doc_id":"e","page":null},{"page":""},"x",""],"deep":[{"bul_case":1.5},{"a_b":true,"c":{}}]}'),
    )
    return table(s, d, "events").select("event_id", J.render_value(body).alias("cited"))


@query("j12_run_quality", "with s as (select user_id run_id, case event_type when 'click' then 'tool' when 'view' then 'memory' else 'x' end kind, event_id % 4 <> 0 ok, event_id t, 1 ms from events), a as (select run_id, count(*) filter (where kind = 'tool') c, count(*) filter (where kind = 'memory' and not ok) f, cast(sum(t) as bigint) tokens, cast(sum(ms) as bigint) ms from s group by 1) select run_id, c tool_calls, case when c >= 6 then 'deep' when c >= 3 then 'moderate' when c >= 1 then 'shallow' else 'none' end as depth, " + R("greatest(0, 1 - 0.2e0 * f)", 2) + " completeness, tokens, ms from a")
def j12(s, d):
    """Depth and completeness of runs."""
    kind = F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "view", "memory").otherwise("x")
    return J.run_quality(table(s, d, "events").select(F.col("user_id").alias("run_id"), kind.alias("kind"), (F.col("event_id") % 4 != 0).alias("ok"), F.col("event_id").alias("tokens"), F.lit(1).alias("ms")))


# --- events ----------------------------------------------------------------------------------------


def _feed(s, d):
    e = table(s, d, "events")
    host = F.when(F.col("user_id") % 3 == 0, "www.nseindia.com").otherwise("news.example.org")
    title = F.when(F.col("event_id") % 11 == 0, "Trading Window closure").otherwise(F.concat(F.lit("Title "), (F.col("event_id") % 700).cast("string")))
    return e.select(F.concat(F.lit("https://"), host, F.lit("/"), F.col("event_id").cast("string")).alias("url"), title.alias("title"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("no"), F.when(F.col("user_id") % 3 == 0, 1).otherwise(2).alias("tier"))


_FEED = """with f as (select event_id no, 'https://' || case when user_id % 3 = 0 then 'www.nseindia.com' else 'news.example.org' end || '/' || event_id url, case when event_id % 11 = 0 then 'Trading Window closure' else 'Title ' || (event_id % 700) end title, ts from events),
 ev as (select md5(url || '-' || title) event_id, title, url, case when contains(url, 'nse') then 'nseindia.com' else 'news.example.org' end source, case when contains(url, 'nse') then 1 else 2 end tier, ts from f),
 pf as (select * from ev where not regexp_matches(title, '(?i)trading window') qualify row_number() over (partition by lower(title) order by ts, event_id) = 1)"""


@query("t1_events", _FEED + " select * from ev")
def t1(s, d):
    """Events of a feed."""
    return T.events_from_feed(_feed(s, d))


@query("t2_prefilter", _FEED + " select * from pf")
def t2(s, d):
    """Events without noise and repeated titles."""
    return T.prefilter(T.events_from_feed(_feed(s, d)))


_SIG = _FEED + ", sc as (select event_id, cast(('0x' || substr(event_id, 1, 2))::int % 100 as int) score, case when substr(event_id, 3, 1) < '8' then 'high' end confidence from ev where substr(event_id, 1, 1) <> '0'), sg as (select pf.*, score, case when tier >= 2 and confidence = 'high' then 'medium' else coalesce(confidence, 'low') end confidence from pf join sc using (event_id) where score >= 60)"


def _signals(s, d):
    ev = T.events_from_feed(_feed(s, d))
    score = (F.conv(F.substring("event_id", 1, 2), 16, 10).cast("int") % 100).alias("score")
    sc = ev.where("substring(event_id, 1, 1) <> '0'").select("event_id", score, F.when(F.substring("event_id", 3, 1) < "8", "high").alias("confidence"))
    return T.signals(T.prefilter(ev), sc)


@query("t3_signals", _SIG + " select event_id, title, score, confidence from sg")
def t3(s, d):
    """Events that matter."""
    return _signals(s, d).select("event_id", "title", "score", "confidence")


@query("t4_impacts", _SIG + " select event_id, score, case when score % 2 = 0 then 'up' else 'neutral' end direction, 'none' magnitude from sg")
def t4(s, d):
    """What events mean for the thesis."""
    sg = _signals(s, d)
    rows = sg.where("score % 2 = 0").select("event_id", F.lit("up").alias("direction"), F.lit(None).cast("string").alias("magnitude"))
    return T.impacts(sg, rows).select("event_id", "score", "direction", "magnitude")


@query("t5_fresh", "select user_id ticker, max(ts) last_fetch, epoch(timestamp '2024-01-31 00:00:00') - epoch(max(ts)) <= 43200 reuse from events group by 1")
def t5(s, d):
    """Fetches recent enough to be used again."""
    e = table(s, d, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("fetched_at"))
    return T.fresh(e, F.lit("2024-01-31 00:00:00").cast("timestamp"), 720)


@query("t5_fetch_windows", "select user_id ticker, time_bucket(interval 20 minute, ts) window_start, count(*) n from events group by 1, 2")
def t5b(s, d):
    """Events in windows of 20 minutes."""
    return T.fetch_windows(table(s, d, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts")))


_T8 = """with s as (select user_id job_id, ts, event_id seq, event_type stage, case when value > 250 then 'active' else 'completed' end state from events), l as (select job_id, stage, max_by(state, (ts, seq, state)) state, max((ts, seq)) mx from s group by 1, 2)
 select job_id, max_by(stage, (mx, stage)) latest_stage, coalesce(string_agg(stage, ',' order by stage) filter (where state = 'active'), '') active, coalesce(string_agg(stage, ',' order by stage) filter (where state = 'completed'), '') completed from l group by 1"""


def _stages(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), F.when(F.col("value") > 250, "active").otherwise("completed").alias("state"))


@query("t8_job_status", _T8)
def t8(s, d):
    """Where jobs stand."""
    return B.job_status(_stages(s, d))


# --- streams and the full run ----------------------------------------------------------------------

_TYPED = REGISTRY.oracles["d1_classify"]


@query("t6_ingest_stream", f"""select c.doc_id, source ticker, cast(case when c.doc_id % 3 = 0 then 2 else 1 end as int) as version, sha256(text) digest from documents c join ({_TYPED}) t using (doc_id)
 where (c.doc_id % 2 = 0 or doc_type <> 'other') and regexp_matches(text, '\\S')""")
def t6(s, d):
    """Documents read as a stream into a store of chunks; half name their type, the rest are typed or refused.

    A third comes first in an earlier state, and that state's chunks are replaced.
    """
    docs = relation(s, d, "corpus").select("doc_id", "ticker", "file_name", "text", F.when(F.col("doc_id") % 2 == 0, "note").alias("doc_type"))
    path = new_folder(s, "ingest")
    early = docs.where("doc_id % 3 = 0").join(_known(docs), "doc_id", "left_semi").withColumn("text", F.concat("text", F.lit(" draft")))
    early.write.parquet(f"{path}/in/a")
    schema = "doc_id long, ticker string, file_name string, text string, doc_type string"
    run = lambda: I.ingest_stream(s, f"{path}/in/*", schema, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    run()
    docs.write.parquet(f"{path}/in/b")
    run()
    store = ChunkStore(s, f"{path}/store")
    stored = store.chunks().select("doc_id").distinct()
    return store.documents().join(stored, "doc_id").select("doc_id", "ticker", "version", "digest")


def _known(docs):
    """Documents that an ingest takes."""
    kind = F.coalesce("doc_type", D.classify_documents(F.col("text")))
    return docs.where((kind != "other") & F.col("text").rlike(r"\S")).select("doc_id")


@contextmanager
def _state_in_rocksdb(s):
    """Processors with state need this provider, and a store for each task slot or two, as each costs time a trigger; the session's own settings are put back."""
    slots = 2 * s.sparkContext.defaultParallelism
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    wanted["spark.sql.shuffle.partitions"] = str(min(slots, int(s.conf.get("spark.sql.shuffle.partitions"))))
    held = {name: s.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        s.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            s.conf.unset(name) if value is None else s.conf.set(name, value)


@query("t7_swing_stream", _EP + " select ticker, kind, \"start\", start_px, \"end\", end_px, ongoing from ep")
def t7(s, d):
    """Swings of prices that arrive out of order, a file a trigger: the last view equals the batch, open moves too."""
    path = new_folder(s, "swings")
    prices = relation(s, d, "prices")
    # one file for every half year and half of the tickers' weeks; a week may come a year after later ones
    file_no = F.floor(F.months_between("dt", F.lit("1990-01-01")) / 6) + 2 * F.pmod(F.xxhash64("ticker", "dt"), F.lit(2))
    parts = prices.withColumn("file_no", file_no.cast("int"))
    parts.write.partitionBy("file_no").parquet(f"{path}/all")
    held = s.read.parquet(f"{path}/all")
    for row in held.select("file_no").distinct().orderBy("file_no").toLocalIterator():  # some two a year
        held.where(F.col("file_no") == row["file_no"]).select(*prices.columns).coalesce(1).write.mode("append").option("parquet.block.size", 8 << 20).parquet(f"{path}/in")  # read in parts
    out = None
    with _state_in_rocksdb(s):
        stream = s.readStream.schema(prices.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = W.swing_stream(stream, delay="420 days")
        save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        writer = out.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint")
        writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    moves = W.current_swings(s.read.schema(out.schema).parquet(f"{path}/out"))
    px = lambda c: exprs.r(F.col(c), 2).alias(c)
    return moves.select("ticker", "kind", "start", px("start_px"), "end", px("end_px"), "ongoing")


@query("t8_job_stream", _T8)
def t8_stream(s, d):
    """Where jobs stand, kept as state while their news arrives in no order, a file a trigger."""
    path = new_folder(s, "jobs")
    rows = _stages(s, d)
    rows.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(4))).repartition(4, "part").write.parquet(f"{path}/in")
    with _state_in_rocksdb(s):
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = B.job_status_stream(stream, delay="3650 days")  # each file holds news of all times
        save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        writer = out.writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint")
        writer.outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return B.current_status(s.read.schema(out.schema).parquet(f"{path}/out"))


_OWN_TICKER = "concat('S', cast(1 + vec_id % 97 as {}))"
_U2 = f"""with recursive card as ({REGISTRY.oracles["q20_scorecard"]}),
 led as (select 'S' || substr(ticker, 2) ticker, id, agent_name, fiscal_period, metric_category, verified_fact, confidence, score, run_date from ({_L} select * from ledger)),
 ev as (select ticker, greatest(0, least(100, 10 + sum(case when score < 50 then 8 else 3 end))) evasion from led group by 1),
 lp as (select ticker, max_by(fiscal_period, (run_date, id)) period from led group by 1),
 gp as (select led.ticker, metric_category category, count(*) n, min(id) id from led join lp on led.ticker = lp.ticker and led.fiscal_period = lp.period where score < 50 and agent_name = 'view' group by 1, 2),
 gk as (select * from gp qualify row_number() over (partition by ticker order by n desc, id) <= 5), gt as (select ticker, string_agg(category, ',' order by n desc, id) gaps from gk group by 1),
 v as (select vec_id, {_OWN_TICKER.format("varchar")} ticker, fiscal_year in ('FY22', 'FY24') narrow, embedding from ({VEC})), q as (select vec_id query_id, embedding qvec, ticker qt from v where vec_id % 100 = 0),
 sc as (select q.query_id, v.vec_id, v.ticker, narrow, {R(_COS.format("v.embedding", "q.qvec"), 3)} rel from v join q on q.qt = v.ticker),
 a as (select *, row_number() over (partition by query_id order by rel desc, vec_id) place from sc where narrow), b as (select *, row_number() over (partition by query_id order by rel desc, vec_id) place from sc where ticker not in (select ticker from a)),
 h as (select ticker, false w from a where place <= 5 union all select ticker, true from b where place <= 5), ch as (select ticker, count(*) n_chunks, bool_or(w) widened from h group by 1)
 select ticker, period_year, roe, n_flags, confidence, evasion, case when evasion >= 75 then 'HIGH EVASION — Management is likely deflecting on critical issues'
 when evasion >= 45 then 'MODERATE EVASION — Some hedging detected, selective transparency' when evasion >= 25 then 'LOW EVASION — Minor hedging, mostly transparent communication'
 when evasion is not null then 'TRANSPARENT — Management communication appears forthcoming' end verdict, case when lp.ticker is not null then coalesce(gaps, '') end gaps, coalesce(n_chunks, 0) n_chunks, widened,
 case when lp.ticker is null then 'NO_MEMORY' when roe is null then 'PARTIAL' else 'OK' end status
 from card left join ev using (ticker) left join lp using (ticker) left join gt using (ticker) left join ch using (ticker)"""


@query("u2_research_run", _U2)
def u2(s, d):
    """Scorecard, evasion, memory and passages of every ticker in one job, with a status."""
    card = Q.scorecard(relation(s, d, "facts"), relation(s, d, "quarters"))
    led = relation(s, d, "ledger").withColumn("ticker", F.concat(F.lit("S"), F.substring("ticker", 2, 9)))
    gaps = led.where("score < 50").groupBy("agent_name", "ticker", "fiscal_period", F.col("metric_category").alias("category")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = led.select(F.lit("view").alias("agent_name"), "ticker", F.lit(None).cast("string").alias("fiscal_period")).distinct()
    memory = M.memory_block(led.withColumn("correction_type", F.lit("NUMBER")), gaps, asked, F.lit("2024-06-01").cast("date"))
    items = led.select("ticker", F.when(F.col("score") < 50, "dodge").otherwise("phrase").alias("kind"), F.lit("LOW").alias("level"))
    chunks = relation(s, d, "vec").withColumn("ticker", F.expr(_OWN_TICKER.format("string")))
    queries = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("ticker").alias("q_ticker"))
    texts = chunks.select("vec_id", F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"))
    passages = V.assemble(chunks, queries, texts, ["FY22", "FY24"]).select("ticker", "n_chunks", "widened")
    out = card.join(J.evasion_score(items).select("ticker", F.col("score").alias("evasion"), "verdict"), "ticker", "left")
    out = out.join(memory.select("ticker", "facts", "gaps"), "ticker", "left").join(passages, "ticker", "left")
    status = F.when(F.col("facts").isNull(), "NO_MEMORY").when(F.col("roe").isNull(), "PARTIAL").otherwise("OK")
    found = F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    return out.select("ticker", "period_year", "roe", "n_flags", "confidence", "evasion", "verdict", "gaps", found, "widened", status.alias("status"))
