"""Small literal tables with results worked out by hand, and invariants of what SQL cannot express."""

import datetime as dt
import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs, fiscal, labels
from ledgerloom.operators import docs as D
from ledgerloom.operators import findings as J
from ledgerloom.operators import ledger as M
from ledgerloom.operators import normalize as N
from ledgerloom.operators import prices as P
from ledgerloom.operators import quant as Q
from ledgerloom.operators import retrieval as V
from ledgerloom.plans.tables import relation
from ledgerloom.sources import scans as S
from ledgerloom.sources.store import ChunkStore
from ledgerloom.streaming import events as T
from ledgerloom.streaming.pipelines import ingest_stream


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    cells = ["14,000", "12%", "-", "nan", "3.2x", "₹45", "", None, "abc", " 1 000 "]
    assert column(spark, cells, exprs.to_number) == [14000.0, 12.0, None, None, 3.2, 45.0, None, None, None, 1000.0]
    assert column(spark, cells, lambda c: exprs.to_number(c, "quarterly"))[4] is None
    assert column(spark, ["-", "x", "7"], lambda c: exprs.to_number(c, "archive")) == [0.0, 0.0, 7.0]


def test_labels(spark):
    assert column(spark, ["Sales +", "Net Profit+", "OPM  %", " A++ "], exprs.clean_label) == ["Sales", "Net Profit", "OPM  %", "A+"]
    assert column(spark, [" A++ "], lambda c: exprs.clean_label(c, "lookup")) == ["A"]


def test_loose_dates(spark):
    got = column(spark, ["FY24", "Q3 FY25", "Dec-2025", "April 2024", "2024", "soon", "Q4FY2026"], fiscal.financial_yyyymm)
    assert got == [202403, 202412, 202512, 202404, 202412, 0, 202603]
    pairs = spark.createDataFrame([("FY24", "FY23"), ("FY23", "FY24"), ("N/A", "FY01"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(fiscal.chronology_ok("a", "b")).collect()] == [False, True, True, True]


def test_windows(spark):
    assert column(spark, ["Q3_FY26", "FY00", "CY25", "none"], fiscal.fiscal_window) == [["FY26", "FY25"], ["FY00", "FY99"], ["FY26", "FY25", "FY24"], None]


STAMPS = [
    ("a.pdf", "for the quarter ended December 31, 2025", "Q3_FY26", "content_quarter_ended"),
    ("a.pdf", "for the year ended March 31, 2024", "FY24", "content_year_ended"),
    ("Q3_FY26_x.pdf", "", "Q3_FY26", "filename_q_fy"),
    ("Annual_FY2024.pdf", "", "FY24", "filename_fy"),
    ("Financial_Year_2023.pdf", None, "FY23", "filename_fy"),
    ("Q3_2022.pdf", "", "Q2_FY23", "filename_q_year"),
    ("Mar_2025.pdf", "", "Q4_FY25", "filename_month_year"),
    ("report 2021.pdf", "", "FY21", "filename_year"),
    ("x.pdf", "nothing", "UNKNOWN", "none"),
    (None, None, "UNKNOWN", "none"),
]


def test_period_stamps(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(STAMPS)], "i int, a string, b string")
    got = df.select("i", fiscal.stamp_period("a", "b").alias("p")).orderBy("i").collect()
    assert [(r["p"]["fiscal_period"], r["p"]["rule"]) for r in got] == [(c, d) for *_, c, d in STAMPS]


def test_published_dates(spark):
    got = column(spark, ["call 2024-02-07", "7/2/2024", "7 Feb 2024 call", "Feb 2024", "Q3 FY24", "none"], fiscal.published_date)
    d = dt.date
    assert got == [d(2024, 2, 7), d(2024, 2, 7), d(2024, 2, 7), d(2024, 2, 29), d(2023, 12, 31), None]


def test_quarter_order(spark):
    df = spark.createDataFrame([("Mar 2024",), ("Dec 2023",), ("odd",)], "q string")
    assert [r["q"] for r in df.orderBy(fiscal.quarter_key("q")).collect()] == ["odd", "Dec 2023", "Mar 2024"]


# --- scans ---


def test_statement_scan(spark, tmp_path):
    rows = [
        {"ticker": "A", "statement": "Profit & Loss", "row_no": 0, "row": {"": "Sales +", "Mar 2023": "1,000", "Mar 2024": "1,200", "TTM": "9"}},
        {"ticker": "A", "statement": "Profit & Loss", "row_no": 1, "row": {"": "Sales+", "Mar 2024": "1,300"}},
        {"ticker": "A", "statement": "Profit & Loss", "row_no": 2, "row": {"": "", "Mar 2024": "5"}},
        {"ticker": "B", "statement": "Odd & Table", "row_no": 0, "row": {"Line Item": "X", "Dec 2023": None}},
    ]
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, rows)))
    facts = N.unpivot_statements(S.read_statements(spark, str(tmp_path)))
    got = sorted((r["ticker"], r["statement"], r["line_item"], r["period"], r["value"]) for r in facts.collect())
    assert got == [("A", "profit_loss", "Sales", "Mar 2023", 1000.0), ("A", "profit_loss", "Sales", "Mar 2024", 1300.0), ("B", "odd_and_table", "X", "Dec 2023", None)]


def test_quarterly_csv(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ABC.csv").write_text('Metric,Mar 2024,Jun 2024\nSales,"1,000",2x\n,1,2\nRaw PDF,a,b\n')
    got = sorted((r["ticker"], r["line_item"], r["period"], r["value"]) for r in S.read_quarterly_csv(spark, str(tmp_path)).collect())
    assert got == [("ABC", "Sales", "Jun 2024", None), ("ABC", "Sales", "Mar 2024", 1000.0)]


def test_headings_set_and_clear_categories(spark):
    html = '<h3>Annual Reports</h3><a href="/r.pdf">FY24</a><a href="#x">no</a><h4>Other</h4><a href="https://e.org/login">in</a><a href="https://icra.in/y">Rating</a>'
    got = S.harvest_links(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("place").collect()
    assert [(r["category"], r["url"]) for r in got] == [("annual_reports", "https://example.com/r.pdf"), (None, "https://icra.in/y")]


def test_links_carry_dates_and_kinds(spark):
    html = '<h3>Concalls Feb 2026</h3><a href="/a">Transcript</a><a href="https://youtu.be/x">Call 10 Sep 2025</a><h3>Annual Reports</h3><a href="/b">Financial Year 2024 from 2023</a><a href="/c">Report</a>'
    got = S.harvest_links(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("place").collect()
    assert [(r["doc_type"], r["date"]) for r in got] == [("transcript", "Feb 2026"), ("recording", "10 Sep 2025"), ("document", "2024"), ("document", None)]


def test_links_of_calls_take_the_period_around_them(spark):
    html = (
        '<h3>Concalls</h3><ul><li><div>Feb 2026</div><a href="/a">Transcript</a><a href="/b" title="Raw transcript">x</a></li><li><a href="/c">PPT</a><a href="/d">REC Nov 2025</a></li></ul>'
        '<a href="/e">y</a><h3>Announcements 2024</h3><p>Jan 2023</p><a href="/f"></a><a href="/g" title="Notice 2021"></a>'
    )
    got = S.harvest_links(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("place").collect()
    assert [(r["name"], r["doc_type"], r["date"]) for r in got] == [
        ("Feb 2026", "transcript", "Feb 2026"), ("Feb 2026", "transcript", "Feb 2026"), ("Nov 2025", "ppt", "Nov 2025"), ("Nov 2025", "recording", "Nov 2025"),
        ("Nov 2025", "document", "Nov 2025"), ("f", "document", None), ("Notice 2021", "document", "2021"),
    ]


def test_first_keyword_decides(spark):
    rows = [("Gross margin and volume", "FMCG"), ("volume fell", "Private Sector Bank"), ("", "IT - Software"), (None, None), ("court case", "automobile parts")]
    df = spark.createDataFrame(rows, "a string, b string").select(labels.metric_category("a"), labels.vertical("b"))
    assert [tuple(r) for r in df.collect()] == [("margins", "manufacturer"), ("volume_growth", "bank"), ("uncategorized", "it_services"), ("uncategorized", "other"), ("litigation", "auto")]


def test_action_and_strength(spark):
    rows = [("add on dips", 0.795), (" Exit ", 0.5), ("Neutral", 3.0), ("", 0.1), (None, None)]
    pct, strength = Q.cash_strength(F.col("x"))
    got = spark.createDataFrame(rows, "t string, x double").select(labels.action_bucket(F.col("t")), pct, strength).collect()
    assert [tuple(r) for r in got] == [("add", 80, "STRONG"), ("sell", 50, "MODERATE"), ("hold", 100, "STRONG"), (None, 10, "WEAK"), (None, None, None)]


def test_archive_policy(spark):
    rows = [(1, 0, "FY19 report", "https://a/x.pdf"), (1, 1, "Report 2024", "https://a/y.pdf"), (1, 2, "again", "https://a/y.pdf"), (1, 3, "rating", "https://www.icra.in/z"), (1, 4, "page", "https://a/z")]
    got = S.archive_policy(spark.createDataFrame([(*r, None) for r in rows], "page_id long, place int, name string, url string, category string")).collect()
    assert {(r["name"], r["category"]) for r in got} == {("Report 2024", "important"), ("rating", "credit_ratings")}


# --- prices ---


def ramp(spark, values, ticker="X"):
    return spark.createDataFrame([(ticker, dt.date(2020, 1, 6) + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(values)], "ticker string, dt date, close_px double")


def test_swings_of_a_ramp(spark):
    got = P.swing_episodes(ramp(spark, [100, 110, 130, 150, 140, 120, 100, 90, 95, 110, 130])).orderBy("start").collect()
    assert [(r["kind"], r["start_px"], r["end_px"], r["ongoing"]) for r in got] == [("rally", 100.0, 150.0, False), ("decline", 150.0, 90.0, False), ("rally", 90.0, 130.0, True)]
    assert P.swing_episodes(ramp(spark, [100, 200, 50])).count() == 0


def test_swing_invariants(spark, sf_dir):
    got = P.swing_episodes(relation(spark, sf_dir, "prices")).orderBy("ticker", "start").collect()
    for a, b in zip(got, got[1:], strict=False):
        if a["ticker"] == b["ticker"]:
            assert a["end"] == b["start"] and a["kind"] != b["kind"] and not a["ongoing"]
    assert all(abs(r["change_pct"]) >= 25 - 0.1 for r in got if not r["ongoing"])


# --- documents ---


def test_chunks_keep_tables_whole(spark):
    text = "".join(f"Sentence number {i} of the text. " for i in range(900))
    table = "\n".join(f"| a{i} | {i} |" for i in range(60))
    text = text[:3700] + "\n" + table + "\n" + text[3700:]
    df = spark.createDataFrame([(1, 0, "note", text), (2, 0, "annual_report", text), (3, 0, "note", ""), (4, 0, "note", None)], "doc_id long, section_no int, doc_type string, text string")
    got = D.chunk_text(df).orderBy("doc_id", "chunk_no").collect()
    assert {r["doc_id"] for r in got} == {1, 2} and all(r["text"] in text for r in got)
    first = next(r for r in got if r["doc_id"] == 1)
    assert first["text"].endswith("| a59 | 59 |")  # the table is not cut


def plain_tables(text):
    """Letters that a table holds, one flag each and some beyond the end."""
    lines, flags = text.split("\n"), [False] * (len(text) + 2)
    at, k = 0, 0
    while k < len(lines):
        n = k
        while n < len(lines) and re.match(D.TABLE_LINE, lines[n]):
            n += 1
        size = sum(len(x) + 1 for x in lines[k:n])
        if n - k - (n == len(lines)) >= 2:
            flags[at : at + size] = [True] * size
        at, k = at + size + (len(lines[n]) + 1 if n < len(lines) else 0), n + 1
    return flags


def plain_chunks(text, size, overlap):
    if len(text) <= size:
        return [text] if text.strip() else []
    table, out, start = [*plain_tables(text), *[False] * (2 * size)], [], 0
    while start < len(text):
        end = start + size
        if table[end]:
            while table[end]:
                end += 1
            end = min(end, len(text))
        elif end < len(text):
            for mark in (". ", ".\n", ";\n", "\n\n"):
                head, found, _ = text[end - size // 5 : end].rpartition(mark)
                if found and not table[end - size // 5 + len(head) + len(mark)]:
                    end = end - size // 5 + len(head) + len(mark)
                    break
        if text[start:end].strip():
            out.append(text[start:end].strip())
        start = end - overlap
    return out


def test_chunks_equal_a_plain_version_on_random_texts(spark):
    rng = random.Random(7)
    pieces = ["word ", "other. ", "end.\n", "part;\n", "\n\n", "| a | b |\n", "Revenue   1,200\n", "a, (b)\tc\n", "--- x\n", "a | b\n", "é   -\n", "    ", "\n", "long" * 50]
    rows = []
    for i in range(60):
        weights = [rng.random() ** 3 for _ in pieces]
        rows.append((i, 0, rng.choice(["note", "financial_data", None]), "".join(rng.choices(pieces, weights, k=rng.choice((3, 900, 2500))))))
    df = spark.createDataFrame(rows, "doc_id long, section_no int, doc_type string, text string")
    got = {}
    for r in D.chunk_text(df).orderBy("doc_id", "chunk_no").collect():
        assert r["chunk_no"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append(r["text"])
    want = {i: c for i, _, kind, t in rows if (c := plain_chunks(t, *((8000, 1600) if kind == "financial_data" else (4000, 800))))}
    assert got == want and sum(map(len, want.values())) > 150


def test_the_first_separator_in_order_decides(spark):
    text = "x" * 3400 + ". " + "y" * 300 + ";\n" + "z" * 3000
    df = spark.createDataFrame([(1, 0, "note", text)], "doc_id long, section_no int, doc_type string, text string")
    assert D.chunk_text(df).orderBy("chunk_no").first()["text"] == "x" * 3400 + "."


def test_table_lines(spark):
    yes = ["| a", "  |", "a b\tc", "Revenue   1,200", "Net (loss).    -3%", "--- x"]
    no = ["a | b", "1,200  3", "Revenue: 1   2", "-- x", "", "a-b\tc"]
    df = spark.createDataFrame([(i, f"{x}\n{x}\nend") for i, x in enumerate(yes + no)], "doc_id long, text string")
    assert {r["doc_id"] for r in D.table_blocks(df).collect()} == set(range(len(yes)))
    text = "intro\n| a\n| b\nmid\n| c\n| d"
    got = D.table_blocks(spark.createDataFrame([(1, text), (2, text + "\n| e"), (3, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_lines"]) for r in got) == [(1, 6, 14, 2), (2, 6, 14, 2), (2, 18, 30, 3)]


def test_sections_and_questions(spark):
    text = "intro\n  ## Directors Report 2024\nline one\nline two\nCORPORATE  governance\n\nQ & A session\n"
    rows = [(1, text), (2, "Auditor's report\nx"), (3, " \n"), (4, None), (5, "plain")]
    got = D.split_sections(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["section_no"], r["title"], r["start"], r["text"]) for r in got) == [
        (1, 0, "Introduction", 0, "intro\n"), (1, 1, "Directors Report", 6, "  ## Directors Report 2024\nline one\nline two\n"),
        (1, 2, "CORPORATE  governance", 51, "CORPORATE  governance\n\n"), (1, 3, "Q & A", 74, "Q & A session\n"),
        (2, 0, "Auditor's report", 0, "Auditor's report\nx"), (5, 0, "Introduction", 0, "plain"),
    ]


def test_repeated_lines(spark):
    text = "# Head\n1. Margin up\n- # head\n2. margin UP \n* volume\n\n•\n# Head\n  # Head\n\n12.5 volume\n3) x\n) X"
    got = D.dedupe_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == "# Head\n1. Margin up\n- # head\n* volume\n\n•\n# Head\n  # Head\n\n3) x"


def test_questions_by_heading_or_speaker(spark):
    cases = [
        ("hi Question  and answer now\nx", "Question  and answer now\nx"), ("x interactive session y", "interactive session y"),
        ("interactive session then Q&A", "Q&A"), ("a\nthe Moderator : x\nb", "the Moderator : x\nb"), ("analyst\n: x", None), ("", None), (None, None),
    ]
    assert column(spark, [t for t, _ in cases], D.qa_section) == [q for _, q in cases]


def test_snippets_in_three_spellings(spark):
    long = "x" * 300 + " See Note No. 5 " + "y" * 4000
    rows = [(1, long, " note 5 "), (2, "NOTES 5 and note 5", "note 5"), (3, "notes 7", "Note 7"), (4, "none", "Note 9"), (5, None, "Note 9")]
    got = {r["i"]: tuple(r["s"]) for r in spark.createDataFrame(rows, "i int, t string, r string").select("i", D.page_snippet(F.col("t"), F.col("r")).alias("s")).collect()}
    assert got[1] == (long[105:3305], True, 305) and got[2] == ("NOTES 5 and note 5", True, 12) and got[3] == ("notes 7", True, 0)
    assert got[4] == got[5] == ("'Note 9' not found in document.", False, None)


def test_growth_as_calls_state_it(spark):
    rows = [
        (1, "Underlying volume growth stood at 6.5% and price-mix growth was 3 %; rural contribution was 40.25%"),
        (2, "Volumes declined by 4%. Realization hike of 2%. Rural : Urban ratio of 35/64.5"),
        (3, "volume decline of about 7 %"), (4, "rural demand contributed 12%"), (5, ""), (6, None),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in D.growth_split(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gaps = ["Volume vs. price growth not found in available transcripts", "Rural/Urban mix not found in available transcripts"]
    assert got[1] == (6.5, 3.0, 40.25, 59.8, "Volume growth: 6.5% | Price/Mix growth: 3.0%", [])
    assert got[2] == (4.0, 2.0, 35.0, 64.5, "Volume growth: 4.0% | Price/Mix growth: 2.0%", [])
    assert got[3] == (7.0, None, None, None, "Volume growth: 7.0%", gaps[1:]) and got[4] == (None, None, 12.0, 88.0, "", gaps[:1])
    assert got[5] == (None, None, None, None, "", gaps) and got[6][:4] == (None,) * 4


def test_reports_are_rewritten(spark):
    cases = [
        ("The forensic_quant agent flags margins", " margins"), ("Our moat analysis shows that it holds", "it holds"), ("As per our capital review, fine", "fine"),
        ("a direct contradiction contradicts it", "a divergence diverges from it"), ("Cash is strong. Growth  is slowing", "cash conversion is robust. growth rate is decelerating"),
        ("the moat is weakening, not strengthening", "moat durability is weakening"), ("a   b\n  \nx\n , c", "a b\n\nx\nc"),
        ("US generics account for 30% of sales", "US generics account for 30% of sales"),
        ("US OTC represents 30% of sales; U.S. generics comprise about 31% of total revenue; US OTC represents 99% sales", f"US OTC represents 30% of sales; U.S. generics comprise about 31% of total revenue{D.SHARE_NOTE}; US OTC represents 99% sales"),
        (None, None),
    ]
    assert column(spark, [t for t, _ in cases], D.rewrite) == [w for _, w in cases]


def test_hedges_of_a_rows_own_sector_equal_plain_counting(spark):
    rng = random.Random(2)
    every = D.hedges_of()
    names = ["Consumer Food", "private bank", "IT - Software", "Pharma", "Metals", None]
    keys = ["fmcg", "banking", "it_services", "pharma", "general", "general"]
    rows = [(i, "".join(rng.choices([" ", "x ", *[p.title() for p, _ in every]], k=60)), names[i % 6]) for i in range(60)]
    got = {}
    df = spark.createDataFrame(rows, "doc_id long, text string, sector string")
    for r in D.hedging(df, sector_col="sector").orderBy("doc_id", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["phrase"], r["sector_only"], r["n"], r["context"], r["total"]))
    for i, text, _ in rows:
        low, own = text.lower(), [(p.lower(), s) for p, s in every if s in (None, keys[i % 6])]
        found = sorted(((p, s is not None, low.count(p), text[max(0, low.find(p) - 100) : low.find(p) + len(p) + 200].strip()) for p, s in own if p in low), key=lambda x: -x[2])
        assert got.get(i, []) == [(*f, sum(x[2] for x in found)) for f in found[:15]]


def test_each_family_of_risks_has_its_own_context(spark):
    said = {"contingent_liabilities": "contingent liability", "rpt_disclosures": "related party transaction", "audit_red_flags": "qualified opinion", "pledge_mentions": "pledge of shares"}
    rows = [(i, "x" * 600 + f" {words} " + "y" * 600) for i, words in enumerate(said.values())] + [(9, None)]
    got = D.risk_contexts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (family, _) in enumerate(said.items()):
        own = [r for r in got if r["doc_id"] == i and r["family"] == family]
        before, after = D.RISK_CONTEXT[family]
        assert own and all(r["context"] == rows[i][1][r["start"] - before : r["start"] + len(r["match"]) + after] for r in own)


def test_context_and_growth(spark):
    df = spark.createDataFrame([(1, "Volume growth of 6.5% and price growth of 3%; rural is 40%. What now? ok")], "doc_id long, text string")
    r = D.growth_split(df, [r"(?i)volume growth of ([\d.]+)%"], [r"(?i)price growth of ([\d.]+)%"], [r"(?i)rural is ([\d.]+)%"]).first()
    assert (r["volume_pct"], r["price_pct"], r["urban_pct"]) == (6.5, 3.0, 60.0)  # rules of the caller's own
    k = D.kwic(df, [r"growth"], 7, 3).orderBy("start").collect()
    assert [x["context"] for x in k] == ["Volume growth of", " price growth of"]


# --- findings and ledgers ---


def test_truncated_payloads_never_raise(spark):
    whole = '<think>x</think>```json\n{"a": [{"b": 1}], "c": "d"}\n```'
    rows = spark.createDataFrame([(i, whole[:i]) for i in range(len(whole) + 1)], "i int, payload string")
    good, bad = J.parse_payloads(rows)
    assert good.count() + bad.count() == len(whole) + 1 and good.where(F.col("i") == len(whole)).count() == 1


def test_nested_chronology(spark):
    body = '{"x": {"y": [{"cause_date": "FY25", "effect_date": "FY24"}, {"cause_date": "FY23", "effect_date": "FY24"}]}}'
    df = spark.createDataFrame([(1, body), (2, '{"x": 1}')], "id long, j string").select("id", F.parse_json("j").alias("parsed"))
    got = {r["id"]: r for r in J.chronology_scan(df, "id").collect()}
    assert (got[1]["accepted"], got[1]["path"], got[1]["n_violations"], got[2]["accepted"]) == (False, "$.x.y[0000]", 1, True)


def test_evidence_and_findings(spark):
    bodies = [
        '{"a": {"Quote": "q", "b": {"x": 1, "y": 2}}}',  # evidence ends the descent
        '{"a": {"x": 1, "y": 2}, "b": {"z": 1}}',  # one-key leaves don't count
        '{"x": 1}',  # no finding at all
        '[[[[[[[[[[[{"ref": 1}, {"p": 1, "q": {}}]]]]]]]]]]]',  # any depth
        None,
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id long, j string")
    df = df.select("id", F.parse_json("j").alias("parsed"), F.lit(1.0).alias("completeness"), F.when(F.col("id") == 1, 5).otherwise(0).alias("errors"))
    got = [(r["n_grounded"], r["n_findings"], r["confidence"]) for r in J.grounding(df, "id").orderBy("id").collect()]
    assert got == [(1, 1, 1.0), (0, 1, 0.4), (0, 0, 1.0), (1, 2, 0.8), (0, 0, 0.0)]


def test_rules_between_agents(spark):
    rows = [("A", 0.9, ["LOW", "HIGH"], "strong", ["a cautious outlook"]), ("B", 0.8, ["CRITICAL"], "Intact", ["calm", None]), ("C", 0.9, ["high"], None, None)]
    got = {r["ticker"]: r["n_conflicts"] for r in J.conflicts(spark.createDataFrame(rows, "ticker string, cash_quality double, severities array<string>, moat string, tones array<string>")).collect()}
    assert got == {"A": 2, "B": 0, "C": 0}
    rows = [("A", ["HIGH"], True, 3), ("B", ["high"], False, 2), ("C", None, None, None)]
    got = {r["ticker"]: r["rerun"] for r in J.rerun_needs(spark.createDataFrame(rows, "ticker string, severities array<string>, unrelated_acquisitions boolean, n_governance_flags int")).collect()}
    assert got == {"A": "forensic_quant,narrative_decoder,forensic_investigator", "B": "", "C": ""}


def test_evasion_bands(spark):
    items = [("A", "guidance", "Low")] * 4 + [("A", "phrase", None)] + [("B", "dodge", None)] * 8 + [("C", "shift", "medium-high"), ("C", "guidance", "HIGH")]
    got = {r["ticker"]: (r["score"], r["verdict"].split(" — ")[0], r["guidance_misses"], r["tone_shifts"], r["analyst_dodges"], r["flagged_phrases"]) for r in J.evasion_score(spark.createDataFrame(items, "ticker string, kind string, level string")).collect()}
    assert got == {"A": (73, "MODERATE EVASION", 4, 0, 0, 1), "B": (74, "MODERATE EVASION", 0, 0, 8, 0), "C": (20, "TRANSPARENT", 0, 1, 0, 0)}


def test_flags_keep_their_order_and_repeats(spark):
    flags = [("A", 1, "auditor_flags", None, "x"), ("A", 2, "auditor_flags", None, "x"), ("A", 0, "related_party_flags", "high", "y"), ("B", 0, "f", "LOW", None)]
    got = {r["ticker"]: (r["passed"], r["kill_reasons"], r["warnings"]) for r in J.flag_triage(spark.createDataFrame(flags, "ticker string, place int, family string, severity string, text string")).collect()}
    assert got == {"A": (False, "RELATED_PARTY_FLAGS: y", "AUDITOR_FLAGS: x; AUDITOR_FLAGS: x"), "B": (True, "", "F: ")}


def test_agents_in_order(spark):
    names = ["pm_synthesis", "zz", "critic_agent", "forensic_quant"]
    got = J.ordered_summary(spark.createDataFrame([("A", n) for n in names], "ticker string, agent string")).orderBy("place").collect()
    assert [r["agent"] for r in got] == ["forensic_quant", "critic_agent", "pm_synthesis", "zz"]


def test_table_pages_count_all_lines(spark):
    pages = ["1\n\n\n\n2", "1\n2\n(3.5)\n-4,000\nwords", "1\n2\n3\n4", "a\nb\nc\nd\ne\n1 2", "Cash Flow\na\nb\n7\nc\nd"]
    share, table = D.table_pages(F.col("v"))
    df = spark.createDataFrame(list(enumerate(pages)), "i int, v string")
    assert [(r["s"], r["t"]) for r in df.select("i", share.alias("s"), table.alias("t")).orderBy("i").collect()] == [(0.4, True), (0.8, True), (1.0, False), (0.0, False), (0.1667, True)]


def test_label_years(spark):
    labels = ["Form 1234 of 2021", "FY 19 and FY-22", "Dec '18", "Mar 2019", "call", "Sep-21", "Form 1234"]
    assert column(spark, labels, S.label_year) == [2021, 2022, 2018, 2019, None, 2021, None]


def test_auditor_change_and_sources(spark):
    texts = ["emphasis of matter " + "x" * 250 + " change", "emphasis of matter " + "x" * 320 + " change", "the auditors have resigned", "change " + "x" * 150 + " adverse opinion", "change"]
    got = D.risk_signals(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r["auditor_changed"] for r in got] == [True, False, True, True, False]
    fetches = spark.createDataFrame([("A", "News", "timeout"), ("A", "Exchange", "ok"), ("B", "News", "boom"), ("B", "Exchange", None)], "ticker string, source string, outcome string")
    assert sorted(map(tuple, T.unavailable_sources(fetches).collect())) == [("A", "News (Timeout)"), ("B", "News (Error)")]


def test_memory_of_a_period(spark):
    t = dt.datetime
    kind = "id long, ticker string, agent_name string, fiscal_period string, confidence double, verified_fact string, run_date timestamp, correction_type string"
    rows = [(i, "A", "q", "Q1" if i < 4 else "Q2", 0.9 if i != 1 else 0.5, f"f{i}", t(2024, 1, 1 + i), "N" if i % 2 else "P") for i in range(6)]
    gaps = spark.createDataFrame([("q", "A", "Q1", "roic", 2, 1), ("q", "A", "Q1", "debt", 5, 2), ("q", "A", "Q2", "x", 9, 3)], "agent_name string, ticker string, fiscal_period string, category string, n long, id long")
    asked = spark.createDataFrame([("q", "A", "Q1"), ("q", "A", None), ("q", "Z", None)], "agent_name string, ticker string, fiscal_period string")
    got = {(r["ticker"], r["period"]): (r["facts"], r["gaps"], r["pattern"], r["warning"]) for r in M.memory_block(spark.createDataFrame(rows, kind), gaps, asked, F.lit("2024-02-01").cast("date")).collect()}
    assert got == {("A", "Q1"): ("f3; f2; f0", "debt,roic", "3x P, 2x N", False), ("A", "Q2"): ("f5; f4", "x", "3x P, 2x N", False), ("Z", None): ("", "", "3x P, 2x N", True)}


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("A", "x", 1), ("B", "y", 1)], "k string, payload string, at int")
    new = spark.createDataFrame([("B", "z", 2), ("C", "w", 2)], "k string, payload string, at int")
    once = M.upsert(old, new, ("k",), "at")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, M.upsert(once, new, ("k",), "at").collect())) == [("A", "x", 1), ("B", "z", 2), ("C", "w", 2)]


def test_implied_growth_solves_its_equation(spark):
    df = spark.createDataFrame([("A", 3000.0, 100.0), ("B", -1.0, 5.0), ("C", 10.0, 0.0)], "ticker string, market_cap double, fcf double")
    got = {r["ticker"]: r["implied_growth"] for r in Q.implied_growth(df).collect()}
    g = got["A"]
    worth = 100 * (sum(((1 + g) / 1.12) ** t for t in range(1, 11)) + ((1 + g) / 1.12) ** 10 * 1.05 / 0.07)
    assert math.isclose(worth, 3000, rel_tol=2e-3) and got["B"] is None and got["C"] is None


def test_embeddings_are_unit_or_null(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,), ("d",)], "text string")
    got = V.embed(df, 32).select("text", V.dot(F.col("embedding"), F.col("embedding")).alias("n")).collect()
    assert len(got) == 5 and all(r["n"] is None or abs(r["n"] - 1) < 1e-9 or r["n"] == 0 for r in got)


def test_topics_have_the_words_of_their_domain(spark):
    df = spark.createDataFrame([("capital", "dam"), ("none", "x")], "d string, t string").select(V.topic_text(F.col("d"), F.col("t")))
    assert [r[0] for r in df.collect()] == ["capital allocation capex dividend buyback acquisition dam", None]
    chunks = spark.createDataFrame([(i, "T", [1.0, i / 10]) for i in range(6)] + [(9, "U", [1.0, 0.0])], "vec_id long, ticker string, embedding array<double>")
    asked = [(1, "guidance", "t", [1.0, 0.0]), (2, "capital", "T", [1.0, 0.0]), (3, "capital", None, [1.0, 0.0]), (4, "none", "T", [1.0, 0.0])]
    got = V.topic_search(chunks, spark.createDataFrame(asked, "query_id long, domain string, ticker string, qvec array<double>")).collect()
    ids = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["place"]) if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert ids == {1: [0, 1, 2, 3, 4], 2: [0, 1, 2], 3: [None], 4: [None]}


def test_vectors_equal_plain_tf_idf(spark):
    texts = ["red red apple", "green apple", "Red pear, red plum", "pear", "...", None]
    words = [[w for w in re.split(r"\W+", (x or "").lower()) if w] for x in texts]
    held = [w for x, w in zip(texts, words, strict=True) if x is not None]
    idf = {w: math.log((len(held) + 1) / (sum(w in h for h in held) + 1)) for h in held for w in h}

    def plain(a, b, weigh):
        va, vb = ({w: x.count(w) * weigh(w) for w in x} for x in (a, b))
        of = lambda v: math.sqrt(sum(n * n for n in v.values()))
        return sum(n * vb.get(w, 0) for w, n in va.items()) / (of(va) * of(vb))

    df = spark.createDataFrame(list(enumerate(texts)), "vec_id long, text string")
    for by_idf, weigh in ((True, idf.get), (False, lambda w: 1)):
        got = {r["vec_id"]: r["embedding"] for r in V.embed(df, dims=4096, idf=by_idf).collect()}
        assert got[4] is None and got[5] is None
        for a in range(4):
            for b in range(4):
                assert sum(x * y for x, y in zip(got[a], got[b], strict=True)) == pytest.approx(plain(words[a], words[b], weigh))


def test_band_pairs_in_blocks_equal_all_pairs(spark):
    rows = [(i, i % 2 if i else None, [1.0, i / 7.0]) for i in range(40)] + [(99, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {(r["a_id"], r["b_id"]) for r in V.band_pairs(df, "label", 0.5, 0.99, block=3).collect()}
    alike = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    want = {(a, b) for a, g, x in rows[1:40] for b, h, y in rows[1:40] if a < b and g == h and 0.5 <= round(alike(x, y), 4) <= 0.99}
    assert got == want and len(got) > 50


def test_chunk_records_equal_plain_counting(spark):
    text = {1: "One sentence here. " * 700, 2: "short", 3: None}
    kinds = {1: "annual_report", 2: "concall_transcript", 3: "note"}
    rows = [(i, "t", f"f{i}.pdf", kinds[i], f"Q1_FY2{i}", "Q1" if i == 1 else "", 2020 if i == 1 else None, t) for i, t in text.items()]
    docs = spark.createDataFrame(rows, "doc_id long, ticker string, file_name string, doc_type string, fiscal_period string, fiscal_quarter string, calendar_year int, text string")
    parts = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("section_no"), F.lit(t).alias("title")) for k, t in enumerate(("Introduction", "Risk"))])), "doc_type", "text")
    cut = sorted(tuple(r) for r in D.chunk_text(parts).select("doc_id", "section_no", "title", "chunk_no", "text").collect())
    want, number = [], {}
    line = {1: "[Fiscal Period: Q1_FY21 | Quarter: Q1 | Calendar Year: 2020 | Document: Annual Report]\n", 2: "[Fiscal Period: Q1_FY22 | Calendar Year: 0 | Document: Concall Transcript]\n"}
    for i, no, title, k, piece in cut:
        number[i] = number.get(i, 0) + 1
        key = f"t_f{i}.pdf_{title}_{k}_{number[i]}_{piece[:50]}"
        total = sum(c[:2] == (i, no) for c in cut)
        want.append((i, hashlib.md5(key.encode()).hexdigest(), no, title, k, total, line[i] + piece, len(piece)))
    got = D.chunk_records(D.chunk_text(parts), docs).select("doc_id", "chunk_id", "section_no", "title", "chunk_no", "section_chunks", "text", "n_chars")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 4 and {w[0] for w in want} == {1, 2}


def test_claims_against_time_go_at_any_depth(spark):
    bad = {"cause_date": "FY25", "effect_date": "FY23", "inner": {"cause_date": "FY24", "effect_date": "FY20"}}
    good = {"cause_date": "FY21", "effect_date": "FY23", "x": 1}
    bodies = [
        {"z": bad, "a": [1, [good, {"deep": [bad, {"q": {"cause_date": "2024-05", "effect_date": "2023-01"}}]}]], "é": None},
        good, bad, [], {"cause_date": "FY25"}, {"cause_date": None, "effect_date": "FY20"}, {"cause_date": 5, "effect_date": "FY20", "k": bad},
    ]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, None), (91, "{broken")]
    got = {r["id"]: r for r in J.scrub(spark.createDataFrame(rows, "id long, payload string")).collect()}
    gone = J.REMOVED
    want = {0: {"z": gone, "a": [1, [good, {"deep": [gone, {"q": gone}]}]], "é": None}, 1: good, 2: gone, 3: [], 4: bodies[4], 5: bodies[5], 6: {**bodies[6], "k": gone}}
    assert {i: json.loads(got[i]["payload"]) for i in want} == want
    assert got[0]["removed"] == ["FY25 -> FY23", "FY25 -> FY23", "2024-05 -> 2023-01"] and got[2]["removed"] == ["FY25 -> FY23"]
    assert all(got[i]["removed"] == [] for i in (1, 3, 4, 5, 90, 91)) and (got[90]["payload"], got[91]["payload"]) == (None, "{broken")


def test_nested_values_as_text(spark):
    cases = [
        ({"snippet": " Sales rose ", "doc_id": "AR24", "page": 7}, '"Sales rose" — AR24, p.7'),
        ({"doc_id": "AR24", "page": "None"}, "— AR24"), ({"page": 0}, "— p.0"), ({"snippet": "s", "page": None}, '"s"'), ({"chunk_id": "c"}, ""),
        ({"roic_trend": "up", "net_pat": 3, "x": None, "y": " none ", "z": [], "pm_synthesis": {"bul_case": "b"}}, "ROIC Trend: up; Net PAT: 3; PM Synthesis: Bull Case: b"),
        (["a", "", None, {"k": "v"}, ["b", "c"], {"page": ""}], "a • K: v • b • c"), ("None", ""), ([], ""), (1.5, "1.5"), (True, "True"),
    ]
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(90, None), (91, "{x")]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id long, j string").select("id", J.render_value(F.col("j")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases] and got[90] is None and got[91] is None


def test_summary_and_verdict(spark):
    pm = json.dumps({"recommendation": "BUY", "recommendation_rationale": "r", "stock_story": "s", "bull_case": ["a", "b"]})
    rows = [("A", "other", 0.1, None, "", 1.0), ("A", "pm_synthesis", 0.9, ["x"], pm, 2.0), ("A", "forensic_quant", 0.5, [], "{}", None), ("B", "critic_agent", None, None, None, None), ("C", "pm_synthesis", 0.3, None, "[1]", 1.0)]
    df = spark.createDataFrame(rows, "ticker string, agent string, confidence double, reasons array<string>, findings string, seconds double")
    got = {r["ticker"]: r for r in J.trails_summary(df).collect()}
    assert [(t["agent"], t["confidence_reasons"], t["findings"]) for t in got["A"]["trails"]] == [("forensic_quant", [], None), ("pm_synthesis", ["x"], pm), ("other", [], None)]
    assert tuple(got["A"]["verdict"]) == ("BUY", "r", "s", ["a", "b"], [])
    assert tuple(got["B"]["verdict"]) == tuple(got["C"]["verdict"]) == (None, None, None, [], [])


def test_reasons_of_a_score(spark):
    rows = [(1, '{"a": {"x": 1, "y": 2}, "b": {"quote": "q"}}', ["cash flow"], ["wrong year"]), (2, '{"a": {"quote": "q"}}', None, None), (3, None, ["x"], ["y"])]
    df = spark.createDataFrame(rows, "id long, j string, missing array<string>, critical array<string>")
    df = df.select("*", F.parse_json("j").alias("parsed"), F.lit(1.0).alias("completeness"), F.lit(0).alias("errors"))
    got = {r["id"]: r["reasons"] for r in J.grounding(df, "id").collect()}
    assert got == {1: ["Missing required input: cash flow", "Missing evidence for 1 finding(s)", "Critical error: wrong year"], 2: [], 3: ["Agent failed to produce output"]}


def test_gaps_by_agent_and_period(spark):
    kind = "ticker string, agent_name string, fiscal_period string, category string, description string, seen int, id long"
    first = [(" tcs ", "quant", "Q1_FY25", "margins", "no split", 1, 1), ("TCS", "quant", "Q1_FY25", None, "Gross margin is absent", 2, 2), ("TCS", "moat", "Q1_FY25", "margins", "x" * 900, 3, 3), ("TCS", "quant", None, "margins", "later", 4, 4), ("TCS", "quant", "Q1_FY25", "margins", "  ", 5, 5)]
    load = lambda rows: M.gap_rows(spark.createDataFrame(rows, kind))
    store = M.upsert_gaps(load(first).where("false"), load(first))
    store = M.upsert_gaps(store, load([("tcs", "quant", "Q1_FY25", " ", "margin again", 9, 9)]))
    got = {(r["agent_name"], r["fiscal_period"]): (r["category"], r["n"], r["first_seen"], r["last_seen"], r["description"][:12], len(r["description"])) for r in store.collect()}
    assert got == {("quant", "Q1_FY25"): ("margins", 3, 1, 9, "no split", 8), ("moat", "Q1_FY25"): ("margins", 1, 3, 3, "x" * 12, 500), ("quant", "UNKNOWN"): ("margins", 1, 4, 4, "later", 5)}
    silent = M.silent_gaps(store).collect()
    assert [(r["ticker"], r["category"], r["n_periods"], r["periods"], r["total"], r["description"]) for r in silent] == [("TCS", "margins", 2, "Q1_FY25,UNKNOWN", 5, "no split")]


def test_topics_of_requests_without_a_ticker(spark):
    text = "short margin\n\nMargin is here and margin again, at length.\n \nNothing of the kind is said in this one.\n\nA long paragraph that says margin only once."
    asked = spark.createDataFrame([(1, "Margin of it", text), (2, "tax", text), (3, "tax", None)], "query_id long, topic string, doc string")
    got = sorted((r["query_id"], r["place"], r["passage"][:12], r["score"]) for r in V.topic_passages(asked).collect())
    assert got == [(1, 1, "Margin is he", 2), (1, 2, "A long parag", 1), (2, 1, "Not found", 0), (3, 1, "Not found", 0)]
    doc = "x" * 150 + " We expect strong (volume) growth. " + "y" * 400
    asked = spark.createDataFrame([(1, "(volume)", doc), (2, "rain", doc), (3, None, doc)], "query_id long, topic string, doc string")
    got = sorted((r["query_id"], r["place"], r["passage"]) for r in V.topic_guidance(asked).collect())
    assert got == [(1, 1, doc[51:451].strip()), (2, 1, "No guidance found for 'rain'")]


# --- streams ---


def test_ingest_twice_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}. " * 900, "note") for i in range(6)], "doc_id long, text string, doc_type string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in" / "a"))
    store = str(tmp_path / "store")

    def run(checkpoint):
        ingest_stream(spark, str(tmp_path / "in" / "*"), "doc_id long, text string, doc_type string", store, str(tmp_path / checkpoint), n_buckets=4).awaitTermination()
        return ChunkStore(spark, store).chunks().count()

    first = run("c1")
    assert first > 3 and run("c1") == first and run("c2") == first and ChunkStore(spark, store).generation() == 1
    docs.where("doc_id >= 3").write.parquet(str(tmp_path / "in" / "b"))
    assert run("c1") == 2 * first


def test_ingest_types_stamps_refuses_and_replaces(spark, tmp_path):
    schema = "doc_id long, ticker string, file_name string, text string, doc_type string"
    store, counts = str(tmp_path / "store"), str(tmp_path / "counts")

    def run(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / name))
        ingest_stream(spark, str(tmp_path / "in" / "*"), schema, store, str(tmp_path / "cp"), counts, n_buckets=4).awaitTermination()
        return {(r["doc_id"], r["version"], r["title"], r["text"]) for r in ChunkStore(spark, store).chunks().collect()}

    call, report = "Earnings call Q3 FY25\nModerator: welcome", "Annual report\nRisk management\n...."
    first = run("a", [(1, "T", "T_Q3_FY25.pdf", call, None), (2, "T", "x.pdf", "nothing known", None), (3, "T", "y_FY24.pdf", report, None), (4, "T", "z.pdf", None, "note")])
    line = "[Fiscal Period: Q3_FY25 | Quarter: Q3 | Calendar Year: 2024 | Document: Concall Transcript]\n"
    assert {r[0] for r in first} == {1, 3} and (1, 1, "Introduction", line + call) in first
    assert {r[2:] for r in first if r[0] == 3} == {
        ("Introduction", "[Fiscal Period: FY24 | Calendar Year: 2023 | Document: Annual Report]\nAnnual report\n"),
        ("Risk management", "[Fiscal Period: FY24 | Calendar Year: 2023 | Document: Annual Report]\nRisk management\n...."),
    }
    second = run("b", [(1, "T", "T_Q3_FY25.pdf", call + " all", None), (3, "T", "y_FY24.pdf", report, None), (2, "T", "x.pdf", "nothing new", None)])
    assert {(r[0], r[1]) for r in second} == {(1, 2), (3, 1)} and (1, 2, "Introduction", line + call + " all") in second
    assert {(r["doc_id"], r["version"], r["digest"] is None) for r in ChunkStore(spark, store).documents().collect()} == {(1, 2, False), (3, 1, False), (4, 1, False)}
    sizes = {r["batch"]: (r["n_docs"], r["n_refused"], r["n_chunks"], r["n_failed"]) for r in spark.read.parquet(counts).collect()}
    assert sizes == {0: (4, 1, 3, 0), 1: (2, 1, 1, 0)}  # the line with the period gives every chunk a word


def test_titles_are_dropped_within_the_watermark(spark, tmp_path):
    rows = [("a", "Title"), ("b", "title "), ("c", "Trading Window"), ("d", "Other")]
    feed = spark.createDataFrame([(f"https://www.x.org/{u}", t) for u, t in rows], "url string, title string").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    feed.write.parquet(str(tmp_path / "in"))
    stream = T.prefilter_stream(T.events_from_feed(spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("titles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["title"].strip().lower() for r in spark.table("titles").collect()) == ["other", "title"]


@pytest.mark.parametrize("tier,given,want", [(1, "high", "high"), (2, "high", "medium"), (2, None, "low")])
def test_confidence_is_capped(spark, tier, given, want):
    e = spark.createDataFrame([("x", tier)], "event_id string, tier int")
    s = spark.createDataFrame([("x", 70, given)], "event_id string, score int, confidence string")
    assert T.signals(e, s).first()["confidence"] == want
