"""Documents and transcripts: typing, sections, chunks, sweeps for patterns, guidance and hedges."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import count_of, r

#: Size and overlap of chunks for long document types, and for all others.
LONG_TYPES, LONG, SHORT = ("annual_report", "financial_data", "credit_report"), (8000, 1600), (4000, 800)


#: Document types and the patterns that speak for each.
DOC_TYPES = {
    "annual_report": [
        r"(?i)annual\s*report",
        r"(?i)director'?s?\s*report",
        r"(?i)board'?s?\s*report",
        r"(?i)balance\s*sheet\s*as\s*at",
        r"(?i)notes\s*to\s*(?:the\s*)?financial\s*statements",
        r"(?i)auditor'?s?\s*report",
    ],
    "concall_transcript": [
        r"(?i)(?:con\s*call|conference\s*call|earnings\s*call)",
        r"(?i)(?:q[1-4]\s*(?:fy|20))",
        r"(?i)(?:transcript|q\s*&\s*a\s*session)",
        r"(?i)(?:management|moderator)\s*:\s*",
    ],
    "investor_presentation": [
        r"(?i)investor\s*(?:presentation|deck|update)",
        r"(?i)(?:corporate|business)\s*(?:presentation|overview)",
        r"(?i)capital\s*markets?\s*day",
    ],
    "quarterly_results": [
        r"(?i)(?:quarterly|q[1-4])\s*result",
        r"(?i)financial\s*results?\s*for\s*(?:the\s*)?(?:quarter|period)",
        r"(?i)unaudited\s*financial\s*results?",
    ],
    "credit_report": [
        r"(?i)(?:credit|rating)\s*(?:report|rationale|action)",
        r"(?i)(?:crisil|icra|care|india\s*ratings|fitch|moody)",
    ],
    "research_report": [
        r"(?i)(?:equity|stock|sector)\s*research",
        r"(?i)(?:buy|sell|hold|outperform|underperform)\s*(?:rating|target)",
        r"(?i)target\s*price",
    ],
}
#: Headings of sections.
HEADINGS = [
    r"(?i)^(?:#{1,3}\s+)?(director'?s?\s*report)",
    r"(?i)^(?:#{1,3}\s+)?(management\s*discussion\s*(?:and|&)\s*analysis)",
    r"(?i)^(?:#{1,3}\s+)?(notes\s*to\s*(?:the\s*)?financial\s*statements?)",
    r"(?i)^(?:#{1,3}\s+)?(corporate\s*governance)",
    r"(?i)^(?:#{1,3}\s+)?(auditor'?s?\s*report)",
    r"(?i)^(?:#{1,3}\s+)?(risk\s*management)",
    r"(?i)^(?:#{1,3}\s+)?(related\s*party\s*transactions?)",
    r"(?i)^(?:#{1,3}\s+)?(contingent\s*liabilities?)",
    r"(?i)^(?:#{1,3}\s+)?(opening\s*(?:statement|remarks?))",
    r"(?i)^(?:#{1,3}\s+)?(question\s*(?:and|&)\s*answer|q\s*&\s*a)",
    r"(?i)^(?:#{1,3}\s+)?(closing\s*(?:statement|remarks?))",
]
#: Families of risk patterns, and the letters before and after a match that are its context.
RISKS = {
    "contingent_liabilities": [
        r"(?i)contingent\s*liabilit(?:y|ies)",
        r"(?i)off[\s-]*balance[\s-]*sheet",
        r"(?i)corporate\s*guarantee",
        r"(?i)pending\s*litigation",
        r"(?i)claims\s*(?:against|not\s*acknowledged)",
        r"(?i)disputed\s*(?:tax|demand)",
    ],
    "rpt_disclosures": [
        r"(?i)related\s*party\s*(?:transaction|disclosure|dealing)",
        r"(?i)transaction(?:s)?\s*with\s*(?:related|associated)\s*(?:party|parties|company|companies)",
    ],
    "audit_red_flags": [
        r"(?i)emphasis\s*of\s*matter",
        r"(?i)qualified\s*opinion",
        r"(?i)adverse\s*opinion",
        r"(?i)disclaimer\s*of\s*opinion",
        r"(?i)material\s*uncertainty.{0,60}going\s*concern",
        r"(?i)going\s*concern\s*(?:assumption|doubt|uncertainty)",
        r"(?i)(?:resignation|removal)\s*of\s*(?:the\s*)?(?:statutory\s*)?auditor",
        r"(?i)auditor[s]?\s*(?:has|have|had)?\s*resigned",
        r"(?i)change\s*(?:of|in)\s*(?:the\s*)?statutory\s*auditor",
    ],
    "pledge_mentions": [
        r"(?i)promoter[s']*\s*(?:share[s]?\s*)?(?:pledge|pledged|encumber)",
        r"(?i)(?:pledge|encumbrance)\s*(?:of|on)\s*(?:promoter|shares)",
        r"(?i)shares?\s*pledged\s*(?:by|with)",
    ],
}
#: What near an audit flag says that the auditor changed.
AUDITOR_CHANGE = r"(?i)resign|removal|change"
#: Evasive phrases of all sectors, and of one.
HEDGES = [
    "challenging environment", "one-time", "one time", "strategic investment", "going forward", "as I said", "let me clarify",
    "I think we need to", "it's too early to", "we'll have to wait", "difficult to predict", "cautiously optimistic",
    "calibrated approach", "headwinds", "sustainable profitable growth", "long-term value creation", "we remain confident", "broadly in line",
]
SECTOR_HEDGES = {
    "fmcg": [
        "controlling controllables", "premiumization journey", "right-sizing portfolio", "calibrated pricing", "investing behind brands",
        "grammage rationalization", "building distribution muscle",
    ],
    "banking": ["granular monitoring", "proactive provisioning", "dispensation period", "restructured book", "elevated slippages", "one-off recovery"],
    "it_services": ["deal pipeline robust", "seasonal furloughs", "ramp-up delays", "vendor consolidation opportunity", "discretionary spending pause"],
    "pharma": ["price erosion environment", "regulatory pathway clarity", "complex generics portfolio"],
}
#: Words of a sector's name and the set of phrases it takes.
SECTORS = [
    ("fmcg", "fmcg"), ("consumer", "fmcg"), ("food", "fmcg"), ("personal care", "fmcg"), ("household", "fmcg"),
    ("bank", "banking"), ("financial", "banking"), ("nbfc", "banking"), ("insurance", "banking"),
    ("software", "it_services"), ("it ", "it_services"), ("technology", "it_services"), ("consulting", "it_services"),
    ("pharma", "pharma"), ("drug", "pharma"), ("healthcare", "pharma"),
]
#: Forward-looking passages, in Python's spelling.
GUIDANCE = [
    r"(?i)(?:we expect|guidance|outlook|target|aim to|going forward).*?(?:growth|margin|revenue|volume|capex)",
    r"(?i)(?:growth|margin|revenue|volume).*?(?:we expect|guidance|outlook|target)",
    r"(?i)(?:next quarter|coming quarter|H[12]|FY\d{2,4}).*?(?:we expect|guidance|target|guide)",
]
#: An analyst's question up to its mark.
QUESTION = (
    r"(?i)(?:question|could you|would you|can you|what is|what are|how do you|"
    r"why did|please share|any guidance|any color|any update|elaborate on).*?\?"
)
#: Words of financial statements and of disclosures.
STATEMENT_WORDS = [
    "balance sheet", "profit and loss", "statement of profit", "cash flow", "total assets", "revenue from operations",
    "shareholders", "equity and liabilities", "particulars", "notes to", "schedule",
]
DISCLOSURE_WORDS = [
    "related party", "contingent liabilities", "remuneration", "audit fees", "managerial remuneration", "key management personnel",
    "loans and advances", "segment reporting", "deferred tax", "employee benefit", "gratuity", "lease liabilities",
]


def hedges_of(sector: str | None = None) -> list[tuple[str, str | None]]:
    """(phrase, sector or null) for one set of SECTOR_HEDGES, or for all sets if none is named."""
    sets = SECTOR_HEDGES if sector is None else {sector: SECTOR_HEDGES.get(sector, [])}
    return [(p, None) for p in HEDGES] + [(p, name) for name, own in sets.items() for p in own]


def classify_documents(text: Column, patterns: dict[str, list[str]] | None = None, head: int = 5000) -> Column:
    """The type most of whose patterns occur in the head; the first on ties; `other` if none does."""
    patterns = DOC_TYPES if patterns is None else patterns
    start = F.substring(text, 1, head)
    scores = {t: reduce(lambda a, b: a + b, [start.rlike(p).cast("int") for p in ps]) for t, ps in patterns.items()}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    named = reduce(lambda acc, kv: acc.when(kv[1] == best, kv[0]), scores.items(), F.when(best == 0, "other"))
    return F.coalesce(named, F.lit("other"))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def split_sections(docs: DataFrame, headings: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, section_no, title, start, text): a line that a heading's pattern begins starts a section; blank ones go.

    The line is trimmed before it is matched and stays in its section; the title is the first group, never empty, of the
    first pattern that matches. What stands before the first heading is the
    Introduction. One fold over a text's lines notes the headings; no line leaves its row. A null text has no sections.
    """
    head = "struct<at: int, title: string>"
    title = lambda x: F.coalesce(*[F.nullif(_stripped(F.regexp_extract(x, p, 1)), F.lit("")) for p in headings or HEADINGS])
    lines = F.split("text", "\n")
    named = F.zip_with(lines, F.transform(F.transform(lines, _stripped), title), lambda x, t: F.struct(F.length(x).alias("n"), t.alias("title")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{head}>").alias("heads"))

    def step(s: Column, x: Column) -> Column:
        here = F.array(F.struct(s["at"].alias("at"), x["title"].alias("title")))
        return F.struct((s["at"] + x["n"] + 1).alias("at"), F.when(x["title"].isNotNull(), F.concat(s["heads"], here)).otherwise(s["heads"]).alias("heads"))

    rows = docs.select(id_col, "text", F.aggregate(named, start, step)["heads"].alias("_f"))
    opening = F.array(F.struct(F.lit(0).alias("at"), F.lit("Introduction").alias("title")))
    rows = rows.select(id_col, "text", F.when(F.get("_f", F.lit(0))["at"] == 0, F.col("_f")).otherwise(F.concat(opening, "_f")).alias("_h"))

    def section(h: Column, no: Column) -> Column:
        end = F.coalesce(F.get("_h", no + 1)["at"], F.length("text"))
        return F.struct(no.alias("section_no"), h["title"].alias("title"), h["at"].alias("start"), F.substring("text", h["at"] + 1, end - h["at"]).alias("text"))

    return rows.select(id_col, F.inline(F.transform("_h", section))).where(F.col("text").rlike(r"\S"))


#: Fixed value: how a line of a table begins, as Python's matcher reads it.
TABLE_LINE = r"^[\s]*(?:[|]|[\w\s,.()]+\t|[\w\s,.()]+\s{3,}[\d,.()%-]+|---)"
#: White space and the letters of words as the other matchers name them.
_SPACE, _WORD = r"\s\x0b\x1c-\x1f\x{85}\p{Z}", r"\p{L}\p{N}_"
#: The same rule for Spark's and DuckDB's matchers.
TABLE_LINE_SQL = TABLE_LINE.replace(r"\s{3,}", f"[{_SPACE}]{{3,}}").replace(r"[\s]", f"[{_SPACE}]").replace(r"\w\s", _WORD + _SPACE).replace(r"\d", r"\p{Nd}")


def table_blocks(docs: DataFrame, id_col: str = "doc_id", min_feeds: int = 2, pattern: str = TABLE_LINE_SQL) -> DataFrame:
    """(id, start, end, n_lines): runs of table lines that hold min_feeds line feeds, from the first line to the next line after them.

    One fold over a text's lines; the last line has no line feed, and a run that it ends counts one beyond the text. A
    null text has none.
    """
    run = "struct<start: int, end: int, n_lines: int>"
    none = F.array().cast(f"array<{run}>")
    start = F.struct(F.lit(0).alias("at"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("n_lines")).alias("run"), none.alias("out"))

    def closed(s: Column, feeds: Column) -> Column:
        return F.when((s["run"]["n_lines"] > 0) & (feeds >= min_feeds), F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        r, end, hit = s["run"], s["at"] + F.length(x) + 1, x.rlike(pattern)
        first = F.when(r["n_lines"] == 0, s["at"]).otherwise(r["start"])
        n = F.when(hit, r["n_lines"] + 1).otherwise(0)
        now = F.struct(first.alias("start"), end.alias("end"), n.alias("n_lines"))
        return F.struct(end.alias("at"), now.alias("run"), F.when(hit, s["out"]).otherwise(closed(s, r["n_lines"])).alias("out"))

    return docs.select(id_col, F.inline(F.aggregate(F.split("text", "\n"), start, step, lambda s: closed(s, s["run"]["n_lines"] - 1))))


#: What a cut may follow, the first that occurs in the final fifth deciding.
SEPARATORS = (". ", ".\n", ";\n", "\n\n")


def chunk_spans(text: str, size: int, overlap: int, blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Cuts of one text: past a table that they would split, else after a separator of the final fifth that no table holds."""
    starts = [b[0] for b in blocks]

    def past_table(at: int) -> int | None:
        k = bisect_right(starts, at) - 1
        return blocks[k][1] if k >= 0 and at < blocks[k][1] else None

    if len(text) <= size:
        return [(0, len(text))]
    spans, start = [], 0
    while start < len(text):
        end = start + size
        if (beyond := past_table(end)) is not None:
            end = min(beyond, len(text))
        elif end < len(text):
            low = end - int(size * 0.2)
            ends = (at + len(s) for s in SEPARATORS if (at := text.rfind(s, low, end)) >= 0)
            end = next((e for e in ends if past_table(e) is None), end)
        spans.append((start, min(end, len(text))))
        start = end - overlap
    return spans


def _table_spans(text: str, table: re.Pattern) -> list[tuple[int, int]]:
    blocks, at, first = [], 0, None
    for line in [*text.split("\n"), None]:
        if line is not None and table.match(line):
            first = at if first is None else first
        elif first is not None:
            if text.count("\n", first, at) >= 2:
                blocks.append((first, at))
            first = None
        at += len(line or "") + 1
    return blocks


def chunk_text(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, section_no, title, chunk_no, start, text): overlapping chunks of each section, batch by batch without a shuffle.

    Sections carry text and doc_type, and a title or none. A section that fits stays as it is; of a longer one each
    chunk is trimmed, and blank chunks go. A null text has no chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = re.compile(TABLE_LINE)
        for pdf in batches:
            out = []
            for key, no, title, kind, text in zip(pdf["id"], pdf["section_no"], pdf["title"], pdf["doc_type"], pdf["text"], strict=True):
                text = text or ""
                size, overlap = LONG if kind in LONG_TYPES else SHORT
                pieces = [(0, text)] if len(text) <= size else [(a, text[a:b].strip()) for a, b in chunk_spans(text, size, overlap, _table_spans(text, table))]
                out += [(key, no, title, k, a, piece) for k, (a, piece) in enumerate(p for p in pieces if p[1].strip())]
            yield pd.DataFrame(out, columns=["id", "section_no", "title", "chunk_no", "start", "text"])

    kind = sections.schema[id_col].dataType.simpleString()
    title = F.col("title") if "title" in sections.columns else F.lit("Full Document").alias("title")
    rows = sections.select(F.col(id_col).alias("id"), "section_no", title, "doc_type", "text")
    return rows.mapInPandas(run, f"id {kind}, section_no int, title string, chunk_no int, start int, text string").withColumnRenamed("id", id_col)


def chunk_records(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Chunks with a deterministic id, a line that names their period and document, and their section's total.

    docs: (id, ticker, file_name, doc_type, and fiscal_period, fiscal_quarter, calendar_year as stamped); nulls count as
    empty, a null year as 0. n_chars counts the chunk without that line.
    """
    rows = chunks.join(docs.select(id_col, "ticker", "file_name", "doc_type", "fiscal_period", "fiscal_quarter", "calendar_year"), id_col)
    total = F.count("*").over(Window.partitionBy(id_col, "section_no")).cast("int")
    number = F.row_number().over(Window.partitionBy(id_col).orderBy("section_no", "chunk_no"))
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [filled("ticker"), filled("file_name"), filled("title"), F.col("chunk_no").cast("string"), number.cast("string"), F.substring("text", 1, 50)]
    quarter = F.when(filled("fiscal_quarter") != "", F.concat(F.lit(" | Quarter: "), "fiscal_quarter")).otherwise("")
    kind = F.initcap(F.translate(filled("doc_type"), "_", " "))
    year = F.coalesce("calendar_year", F.lit(0)).cast("string")
    line = F.concat(F.lit("[Fiscal Period: "), filled("fiscal_period"), quarter, F.lit(" | Calendar Year: "), year, F.lit(" | Document: "), kind, F.lit("]\n"))
    return rows.select(
        id_col, F.md5(F.concat_ws("_", *parts).cast("binary")).alias("chunk_id"), "section_no", "title", "chunk_no", total.alias("section_chunks"),
        F.concat(line, "text").alias("text"), F.length("text").alias("n_chars"),
    )


def table_pages(text: Column, statement_words: list[str] | None = None, disclosure_words: list[str] | None = None) -> tuple[Column, Column]:
    """(share of number-only lines, whether a page is a table); pages under 5 lines are not.

    Lines are those of the trimmed text, blank ones included; a number-only line holds digits and , . ( ) - alone.
    """
    lines = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")
    numeric = F.size(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+$|^\s+", "")).rlike(r"^[,.()-]*[0-9][0-9,.()-]*$")))
    share = numeric.cast("double") / F.size(lines)
    has = lambda ws: reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in ws])
    words = has(statement_words or STATEMENT_WORDS), has(disclosure_words or DISCLOSURE_WORDS)
    table = (F.size(lines) >= 5) & ((share > 0.25) | ((share > 0.15) & words[0]) | ((share > 0.08) & words[1]))
    return F.coalesce(r(share, 4), F.lit(0.0)), F.coalesce(table, F.lit(False))


#: Headings of the questions in order, and what marks a line of a speaker.
QA_HEADINGS = [
    r"(?i)(?:question\s*(?:and|&)\s*answer|q\s*&\s*a|q&a\s*session)",
    r"(?i)(?:analyst\s*q(?:uestion)?s?\s*(?:and|&)\s*a(?:nswer)?s?)",
    r"(?i)(?:interactive\s*session|question\s*session)",
]
QA_SPEAKER = r"(?i)(?:analyst|participant|questioner|moderator)\s*[:\-–]"


def qa_section(text: Column, headings: list[str] | None = None, speaker: str = QA_SPEAKER) -> Column:
    """The text from the first place of the first heading that it has, else from the line of the first speaker, else null."""
    at = F.coalesce(*[F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in headings or QA_HEADINGS])
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda x: x.rlike(speaker)), F.lit(True))
    return F.when(at.isNotNull(), F.substring(text, at, F.length(text))).when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n"))


#: Letters before and after a match of each family of RISKS that are its context.
RISK_CONTEXT = {"contingent_liabilities": (200, 200), "rpt_disclosures": (300, 500), "audit_red_flags": (200, 300), "pledge_mentions": (150, 250)}


def kwic(docs: DataFrame, patterns: list[str], before: int | list[int], after: int | list[int], id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """(id, pattern_no, start, match, context): every match of each pattern, in batches with Python's matcher.

    Spark finds where only the first match stands. before and after: letters of context, for all patterns or for each.
    `most` keeps the first ones of a text in order of pattern, then of place. A null text has no match.
    """
    widths = list(zip(*(x if isinstance(x, list) else [x] * len(patterns) for x in (before, after)), strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(p) for p in patterns]
        for pdf in batches:
            out = []
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                own = [(k, m.start(), m.group()) for k, p in enumerate(compiled) for m in p.finditer(text or "")]
                out += [(key, k, a, g, text[max(0, a - widths[k][0]) : a + len(g) + widths[k][1]]) for k, a, g in own[:most]]
            yield pd.DataFrame(out, columns=["id", "pattern_no", "start", "match", "context"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text")
    return rows.mapInPandas(run, f"id {kind}, pattern_no int, start int, match string, context string").withColumnRenamed("id", id_col)


def risk_contexts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, family, pattern_no, start, match, context) of every match of RISKS, each family with its own trimmed context, in one pass."""
    flat = [(name, k, p) for name, own in RISKS.items() for k, p in enumerate(own)]
    found = kwic(docs, [p for *_, p in flat], [RISK_CONTEXT[n][0] for n, *_ in flat], [RISK_CONTEXT[n][1] for n, *_ in flat], id_col)
    named = F.element_at(F.array(*[F.struct(F.lit(n).alias("family"), F.lit(k).alias("k")) for n, k, _ in flat]), F.col("pattern_no") + 1)
    return found.select(id_col, named["family"].alias("family"), named["k"].alias("pattern_no"), "start", "match", _stripped(F.col("context")).alias("context"))


def guidance(docs: DataFrame, id_col: str = "doc_id", most: int = 10) -> DataFrame:
    """The first forward-looking passages of each text."""
    return kwic(docs, GUIDANCE, 50, 150, id_col, most)


def analyst_questions(docs: DataFrame, id_col: str = "doc_id", most: int = 10) -> DataFrame:
    """The first questions of each text."""
    return kwic(docs, [QUESTION], 50, 300, id_col, most)


def risk_signals(docs: DataFrame, families: dict[str, list[str]] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Whether and how often each family of patterns occurs; a text without letters has no row.

    With the families of RISKS, also whether an audit flag's context (200 letters before, 300 after) speaks of
    a change of auditor.
    """
    families = RISKS if families is None else families
    hits = {name: reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(p)) for p in ps]) for name, ps in families.items()}
    cells = [c for name, n in hits.items() for c in (n.cast("int").alias(f"n_{name}"), (n > 0).alias(f"has_{name}"))]
    if families is RISKS:
        every = "|".join(f"(?:{p.removeprefix('(?i)')})" for p in RISKS["audit_red_flags"])
        near = [rf"(?:resign[\s\S]{{0,194}}|removal[\s\S]{{0,193}}|change[\s\S]{{0,194}})(?:{every})", rf"(?:{every})(?:[\s\S]{{0,294}}resign|[\s\S]{{0,293}}removal|[\s\S]{{0,294}}change)"]
        inside = "|".join(f"(?:{p.removeprefix('(?i)')})" for p in RISKS["audit_red_flags"][6:])
        changed = reduce(lambda a, b: a | b, [F.col("text").rlike(f"(?i){p}") for p in (inside, *near)])
        cells.append(((hits["audit_red_flags"] > 0) & changed).alias("auditor_changed"))
    return docs.where(F.coalesce(F.trim("text"), F.lit("")) != "").select(id_col, *cells)


def sector_key(sector: Column) -> Column:
    """The set of SECTOR_HEDGES that a sector's name asks for; general where none is named or the name is null."""
    low = F.lower(sector)
    return F.coalesce(*[F.when(low.contains(word), key) for word, key in SECTORS], F.lit("general"))


def hedging(
    docs: DataFrame, phrases: list[tuple[str, str | None]] | None = None, id_col: str = "doc_id", top: int = 15, before: int = 100, after: int = 200, sector_col: str | None = None
) -> DataFrame:
    """Counts of each phrase with its first context, the most frequent first, then in order of the list, and the total of all.

    phrases: (phrase, sector or null for all), those of the library if none are given. sector_col names the column of a
    row's sector: only that sector's phrases count there, beside those for all. One column a phrase, then unpivoted: no join.
    """
    low, phrases = F.col("_low"), hedges_of() if phrases is None else phrases
    key = F.lit(None) if sector_col is None else sector_key(F.col(sector_col))
    rows = docs.select(id_col, "text", F.lower("text").alias("_low"), key.alias("_key"))

    def cell(k: int, phrase: str, sector: str | None) -> Column:
        n = count_of(low, phrase)
        if sector is not None and sector_col is not None:
            n = F.when(F.col("_key") == sector, n).otherwise(0)
        named = [F.lit(k).alias("_k"), F.lit(phrase).alias("phrase"), F.lit(sector is not None).alias("sector_only")]
        return F.struct(*named, n.cast("int").alias("n"), F.instr(low, phrase).alias("at"))

    cells = [cell(k, p.lower(), s) for k, (p, s) in enumerate(phrases)]
    rows = rows.select(id_col, "text", F.inline(F.array(*cells))).where("n > 0")
    total = F.sum("n").over(Window.partitionBy(id_col))
    w = Window.partitionBy(id_col).orderBy(F.desc("n"), "_k")
    start = F.greatest(F.col("at") - before, F.lit(1))
    context = _stripped(F.substring("text", start, F.col("at") - start + F.length("phrase") + after))
    return rows.select(id_col, "phrase", "sector_only", "n", context.alias("context"), total.cast("int").alias("total"), F.row_number().over(w).alias("place")).where(F.col("place") <= top)


def candour_score(hedges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """80 less 5 for each hedge, 10 at least, with the five most frequent phrases."""
    phrases = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "phrase")))), lambda x: x["phrase"]), ",")
    return hedges.groupBy(id_col).agg(F.greatest(F.lit(10), 80 - 5 * F.max("total")).cast("int").alias("score"), phrases.alias("key_phrases"))


def rank_passages(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", parting: str = r"\n\s*\n", bonus: int = 10, cut: int = 1000, least: int = 30) -> DataFrame:
    """Paragraphs by how often they hold the query's terms, with a bonus for the whole phrase; a mark where none does."""
    terms = sorted({t for t in query.lower().split() if len(t) > 2})
    rows = docs.select(id_col, F.posexplode(F.split("text", parting)).alias("place", "p")).where(F.length("p") >= least)
    low = F.lower("p")
    score = reduce(lambda a, b: a + b, [count_of(low, t) for t in terms]) + F.when(low.contains(query.lower()), bonus).otherwise(0)
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "place")
    best = rows.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = docs.select(id_col).join(best.select(id_col, "rank", "place", "score", F.substring("p", 1, cut).alias("passage")), id_col, "left")
    return out.withColumns({"rank": F.coalesce("rank", F.lit(1)), "score": F.coalesce("score", F.lit(0)).cast("int"), "passage": F.coalesce("passage", F.lit("NO MATCHING PASSAGE"))})


def page_snippet(text: Column, reference: Column, before: int = 200, after: int = 3000) -> Column:
    """(content, found, position) around a reference in a text, letter case aside; "note 5" is also sought as "note no. 5" and "notes 5".

    The first spelling that the text has decides; position counts from 0 and is null where none is found.
    """
    low, ref = F.lower(text), F.lower(F.trim(reference))
    spellings = [ref, F.replace(ref, F.lit("note "), F.lit("note no. ")), F.replace(ref, F.lit("note "), F.lit("notes "))]
    at = F.coalesce(*[F.nullif(F.call_function("instr", low, s), F.lit(0)) for s in spellings])
    start = F.greatest(at - before, F.lit(1))
    missing = F.concat(F.lit("'"), reference, F.lit("' not found in document."))
    content = F.coalesce(F.substring(text, start, at - start + after), missing)
    return F.struct(content.alias("content"), at.isNotNull().alias("found"), (at - 1).alias("position"))


def first_number(text: Column, patterns: list[str]) -> Column:
    """The number in the first of the ordered patterns that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]).try_cast("double")


#: How calls state growth of volume, of price, and the rural share, in order.
VOLUME_PATTERNS = [
    r"(?i)(?:underlying\s+)?volume\s+growth\s+(?:of|was|at|stood at)\s+(\d+(?:\.\d+)?)\s*%",
    r"(?i)volumes?\s+(?:grew|grew by|declined by|increased by|fell by)\s+(\d+(?:\.\d+)?)\s*%",
    r"(?i)volume\s+(?:growth|decline)\s+of\s+(?:about\s+)?(\d+(?:\.\d+)?)\s*%",
]
PRICE_PATTERNS = [
    r"(?i)price(?:\s*[-/]\s*mix)?\s+growth\s+(?:of|was|at)\s+(\d+(?:\.\d+)?)\s*%",
    r"(?i)pricing\s+(?:contributed|impact|growth)\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*%",
    r"(?i)(?:price|realization)\s+(?:increase|growth|hike)\s+of\s+(\d+(?:\.\d+)?)\s*%",
]
RURAL_PATTERNS = [
    r"(?i)rural\s+(?:contribution|share|mix|revenue)\s+(?:of|was|at|stood at)\s+(\d+(?:\.\d+)?)\s*%",
    r"(?i)rural\s*[:/]\s*urban\s+(?:split|mix|ratio)\s+(?:of|was|at)\s+(\d+(?:\.\d+)?)\s*[:/]\s*(\d+(?:\.\d+)?)",
    r"(?i)rural\s+(?:markets?|demand|growth)\s+(?:contributed|accounted for)\s+(\d+(?:\.\d+)?)\s*%",
]


def growth_split(docs: DataFrame, volume: list[str] | None = None, price: list[str] | None = None, rural: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Volume and price growth, rural and urban share in percent, a summary, and what is not stated.

    A rural pattern with two groups gives the urban share itself; else it is the rest of 100.
    """
    text = F.col("text")

    def shares(p: str) -> Column:
        a = F.regexp_extract(text, p, 1).try_cast("double")
        b = F.regexp_extract(text, p, 2).try_cast("double") if re.compile(p).groups > 1 else r(100 - a, 1)
        return F.when(text.rlike(p), F.struct(a.alias("a"), b.alias("b")))

    share = F.coalesce(*map(shares, rural or RURAL_PATTERNS))
    rows = docs.select(id_col, first_number(text, volume or VOLUME_PATTERNS).alias("volume_pct"), first_number(text, price or PRICE_PATTERNS).alias("price_pct"), share.alias("_s"))
    said = lambda c, name: F.concat(F.lit(f"{name} growth: "), F.col(c).cast("string"), F.lit("%"))
    summary = F.concat_ws(" | ", said("volume_pct", "Volume"), said("price_pct", "Price/Mix"))
    gaps = F.array_compact(F.array(
        F.when(summary == "", "Volume vs. price growth not found in available transcripts"),
        F.when(F.col("_s").isNull(), "Rural/Urban mix not found in available transcripts"),
    ))
    return rows.select(id_col, "volume_pct", "price_pct", F.col("_s.a").alias("rural_pct"), F.col("_s.b").alias("urban_pct"), summary.alias("summary"), gaps.alias("gaps"))


SEGMENTS = "struct<segments: array<struct<name: string, revenue: double, margin: double>>, gaps: array<string>>"


def segments_from_payload(payloads: DataFrame) -> DataFrame:
    """Segment rows and gap rows of each ticker's JSON payload; a bad payload is a gap."""
    rows = payloads.select("ticker", F.from_json("payload", SEGMENTS).alias("p"))
    segments = rows.select("ticker", F.inline("p.segments")).select("ticker", F.lit("segment").alias("kind"), "name", "revenue", "margin")
    bad = F.when(F.col("p").isNull() | (F.col("p.segments").isNull() & F.col("p.gaps").isNull()), F.array(F.lit("bad payload"))).otherwise(F.col("p.gaps"))
    gaps = rows.select("ticker", F.explode(bad).alias("name")).select("ticker", F.lit("gap").alias("kind"), "name", F.lit(None).cast("double").alias("revenue"), F.lit(None).cast("double").alias("margin"))
    return segments.union(gaps)


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines that repeat an earlier one, the bullet or number before them and case aside, go; no shuffle.

    Headings (lines that # begins) and lines that hold no more than a bullet stay, and are no earlier line for others.
    """
    body = lambda x: F.lower(_stripped(F.regexp_replace(x, r"^[\s*•\d.-]+", "")))
    key = lambda x: F.when(_stripped(x).startswith("#"), "").otherwise(body(x))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    # sorted by key and place, a key's first line stands where the key before it differs
    rows = docs.select(id_col, F.array_sort(lines).alias("_o"))
    first = lambda s, j: (j == 0) | (F.get("_o", j - 1)["k"] != s["k"])
    kept = F.filter("_o", lambda s, j: first(s, j) | (s["k"] == ""))
    back = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x"))))
    return rows.select(id_col, F.array_join(F.transform(back, lambda s: s["x"]), "\n").alias("text"))


#: What a report must not say and what it says instead, in order.
REPORT_RULES = [
    (
        r"(?i)\b(?:the\s+)?(?:forensic[\s_]?quant|narrative[\s_]?decoder|moat[\s_]?architect|capital[\s_]?allocator|management[\s_]?quality|forensic[\s_]?investigator"
        r"|pm[\s_]?synthesis|critic[\s_]?agent)\s*(?:agent)?\s*(?:flags?|confirms?|notes?|shows?|indicates?|reveals?|suggests?|finds?|highlights?|warns?|reports?)",
        "",
    ),
    (
        r"(?i)\b(?:our|the)\s+(?:forensic|narrative|moat|capital|management|quant(?:itative)?)\s+(?:analysis|assessment|review|audit|investigation|scan)"
        r"\s+(?:shows?|reveals?|confirms?|indicates?|flags?|suggests?)\s+(?:that\s+)?",
        "",
    ),
    (
        r"(?i)\b(?:according\s+to|based\s+on|as\s+per)\s+(?:our|the)\s+(?:forensic|narrative|moat|capital|management|quant(?:itative)?)"
        r"\s+(?:analysis|agent|module|assessment|review)\s*,?\s*",
        "",
    ),
    (r"(?i)\bdirect\s+contradiction\b", "divergence"),
    (r"(?i)\bcontradicts?\b", "diverges from"),
    (r"(?i)\bcash\s+is\s+(?:good|strong|healthy)\b", "cash conversion is robust"),
    (r"(?i)\bgrowth\s+is\s+slowing\b", "growth rate is decelerating"),
    (r"(?i)\bmasked\s+by\s+a\s+promising\s+narrative\b", "diverges from underlying fundamentals"),
    (r"(?i)\bthe\s+moat\s+is\s+weakening,\s*not\s+strengthening\b", "moat durability is weakening"),
    (r"(?i)\beradicating\s+narrative\s+bias\b", ""),
]
#: A claim of a share of revenue, here of more than 30 percent, and the note that follows the first one.
SHARE_CLAIM = (
    r"(?i:(?:US|U\.S\.)\s+(?:injectables?|generics?|specialty|biosimilars?|OTC)\s+(?:contributes?|accounts?\s+for|represents?|comprises?)\s+"
    r"(?:about\s+|approximately\s+|around\s+|~?\s*)?(?:[1-9][0-9]{2}|0?3[1-9]|0?[4-9][0-9])%\s+(?:of\s+)?(?:total\s+)?(?:revenue|sales|top[\s-]?line))"
)
SHARE_NOTE = " [⚠️ Verify: this percentage may refer to total US geographic revenue, not the specific sub-segment]"
#: What is tidied last.
TIDY = [(r"  +", " "), (r"\n +\n", "\n\n"), (r"(?m)^\s*,\s*", "")]


def rewrite(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """A report after the ordered replacements, with a note behind the first large share of revenue, then tidied."""
    out = reduce(lambda t, rule: F.regexp_replace(t, *rule), REPORT_RULES if rules is None else rules, text)
    noted = F.regexp_replace(out, f"(?s)^(.*?)({SHARE_CLAIM})", f"$1$2{SHARE_NOTE}")
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), TIDY, noted)


def truncate_with_gap(text: Column, n: int) -> tuple[Column, Column]:
    """The first n letters, and the percentage that was cut off."""
    lost = r(F.greatest(F.length(text) - n, F.lit(0)) * 100.0 / F.nullif(F.length(text), F.lit(0)), 1)
    return F.substring(text, 1, n), F.coalesce(lost, F.lit(0.0))


def dodge_rate(labels: DataFrame, key: str, bad: tuple[str, ...], limit: float = 0.30) -> DataFrame:
    """Share of evasive labels, whether it is high, and what is left."""
    rate = r(F.avg(F.col("label").isin(*bad).cast("double")), 2)
    return labels.groupBy(key).agg(rate.alias("dodge_rate")).select(key, "dodge_rate", (F.col("dodge_rate") > limit).alias("high"), r(1 - F.col("dodge_rate"), 2).alias("candour"))


CLAIMS = "struct<claims: array<struct<claim: string, type: string, verdict: string, evidence: string, confidence: double>>, strength: string>"


def claim_verdicts(payloads: DataFrame) -> DataFrame:
    """Claims of each payload with defaults; a payload without claims keeps one row."""
    rows = payloads.select("ticker", F.from_json("payload", CLAIMS).alias("p")).select("ticker", F.coalesce("p.strength", F.lit("UNKNOWN")).alias("strength"), F.inline_outer("p.claims"))
    return rows.select("ticker", "strength", "claim", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("verdict", F.lit("UNVERIFIABLE")).alias("verdict"), "evidence", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def recent_turns(talk: DataFrame, n: int = 6, cut: int = 500) -> DataFrame:
    """The last turns of each conversation as text: blank ones dropped after the cut, long ones trimmed."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = talk.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).where(F.coalesce(F.trim("text"), F.lit("")) != "")
    body = F.when(F.length("text") > cut, F.concat(F.substring("text", 1, cut), F.lit("..."))).otherwise(F.col("text"))
    line = F.concat(F.upper("role"), F.lit(": "), body)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"), F.count("*").cast("int").alias("n_turns"))


def page_text(html: Column) -> Column:
    """Letters of a page: scripts, styles and tags gone, lines trimmed, blank lines dropped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n"), r"<[^>]+>", " ")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
