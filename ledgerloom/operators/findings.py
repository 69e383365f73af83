"""Nested findings: cleaning payloads, grounding, chronology, corrections, conflicts and scores."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import r
from ledgerloom.functions.fiscal import chronology_ok

#: Keys that mark a finding as backed by evidence.
EVIDENCE = ("evidence", "source", "source_citation", "citation", "quote", "basis", "reference", "ref")
#: The order in which agents are listed.
AGENTS = (
    "forensic_quant",
    "forensic_investigator",
    "narrative_decoder",
    "moat_architect",
    "capital_allocator",
    "management_quality",
    "critic_agent",
    "pm_synthesis",
)
#: Severities that count as severe.
SEVERE = ("HIGH", "CRITICAL")
#: Lowest evasion scores of the bands, and their verdicts.
EVASION_BANDS = (
    (75, "HIGH EVASION — Management is likely deflecting on critical issues"),
    (45, "MODERATE EVASION — Some hedging detected, selective transparency"),
    (25, "LOW EVASION — Minor hedging, mostly transparent communication"),
    (0, "TRANSPARENT — Management communication appears forthcoming"),
)


def clean_payload(raw: Column) -> Column:
    """The outermost braces of a model's answer, without its thoughts and fences."""
    bare = F.regexp_replace(raw, r"(?s)<think>.*?</think>", "")
    bare = F.regexp_replace(bare, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_payloads(df: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows with a variant named parsed, rows that could not be read)."""
    rows = df.withColumn("parsed", F.try_parse_json(clean_payload(F.col(column))))
    return rows.where("parsed is not null"), rows.where("parsed is null").drop("parsed")


def _objects(value: object) -> Iterator[tuple[str, dict]]:
    """(path, object) of every object in a JSON value, whatever its depth."""
    todo = [("$", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            yield path, v
            todo += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}[{k:04d}]", x) for k, x in enumerate(v)]


def _evidence(value: object) -> tuple[int, int]:
    """(findings with evidence, findings).

    An object with an evidence key is one finding and is not searched further. Another one is as many
    findings as stand below it, or one if there are none and it has two keys or more.
    """
    counts: dict[int, tuple[int, int]] = {}
    todo = [(value, False)]
    while todo:
        v, done = todo.pop()
        below = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        if isinstance(v, dict) and any(k in EVIDENCE or k.startswith("evidence") or k.endswith("_citation") for k in map(str.lower, v)):
            counts[id(v)] = (1, 1)
        elif not done:
            todo += [(v, True), *((x, False) for x in below)]
        else:
            e, t = (sum(counts[id(x)][k] for x in below) for k in (0, 1))
            counts[id(v)] = (e, 1 if isinstance(v, dict) and not t and len(v) > 1 else t)
    return counts[id(value)]


def _counted(payload: Column) -> Column:
    """(evidence, findings) of a JSON text."""

    @F.pandas_udf("struct<evidence: int, findings: int>")
    def run(payloads: pd.Series) -> pd.DataFrame:
        rows = [_evidence(json.loads(p)) if p is not None else (0, 0) for p in payloads]
        return pd.DataFrame(rows, columns=["evidence", "findings"])

    return run(payload)


def _dated(payload: Column) -> Column:
    """Every object of a JSON text with a cause and an effect date."""
    text = lambda x: x if isinstance(x, str) else json.dumps(x)

    @F.pandas_udf("array<struct<path: string, cause: string, effect: string>>")
    def run(payloads: pd.Series) -> pd.Series:
        def pairs(payload: str | None) -> list[dict]:
            found = _objects(json.loads(payload)) if payload is not None else ()
            both = ((path, o.get("cause_date"), o.get("effect_date")) for path, o in found)
            return [{"path": path, "cause": text(a), "effect": text(b)} for path, a, b in both if a is not None and b is not None]

        return payloads.map(pairs)

    return run(payload)


def grounding(df: DataFrame, key: str) -> DataFrame:
    """0.6 of input completeness and 0.4 of the share of findings with evidence, less 0.1 an error (0.2 at most), with reasons.

    df: (key, parsed, completeness, errors; missing and critical, arrays of the inputs that lack and of errors, or none).
    Without any finding the share is 1; without output the score is 0, and that is the only reason.
    """
    rows = df.withColumn("_c", _counted(F.to_json("parsed")))
    share = F.when(F.col("_c.findings") > 0, F.col("_c.evidence") / F.col("_c.findings")).otherwise(1.0)
    score = 0.6 * F.col("completeness") + 0.4 * share - F.least(0.1 * F.col("errors"), F.lit(0.2))
    held = F.when(F.col("parsed").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    none = F.array().cast("array<string>")
    named = lambda c, text: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(text), x)) if c in df.columns else none
    bare = F.col("_c.findings") - F.col("_c.evidence")
    unproved = F.when(bare > 0, F.array(F.concat(F.lit("Missing evidence for "), bare.cast("string"), F.lit(" finding(s)")))).otherwise(none)
    why = F.concat(named("missing", "Missing required input: "), unproved, named("critical", "Critical error: "))
    reasons = F.when(F.col("parsed").isNull(), F.array(F.lit("Agent failed to produce output"))).otherwise(why)
    return rows.select(key, F.col("_c.evidence").alias("n_grounded"), F.col("_c.findings").alias("n_findings"), r(held, 2).alias("confidence"), reasons.alias("reasons"))


def chronology_scan(df: DataFrame, key: str) -> DataFrame:
    """The first violation of each row, in order of path, among objects at any depth that hold a cause and an effect date.

    df: (key, parsed), key unique.
    """
    pairs = df.select(key, F.explode_outer(_dated(F.to_json("parsed"))).alias("o")).select(key, "o.path", "o.cause", "o.effect")
    bad = pairs.withColumn("bad", F.coalesce(~chronology_ok("cause", "effect"), F.lit(False)))
    found = bad.groupBy(key).agg(F.min(F.when(F.col("bad"), F.col("path"))).alias("path"), F.sum(F.col("bad").cast("int")).cast("int").alias("n_violations"))
    return found.select(key, (F.col("n_violations") == 0).alias("accepted"), "path", "n_violations")


#: Fixed value: what stands in place of a claim whose effect comes before its cause.
REMOVED = {"removed_by_auditor": "Causal claim removed: failed chronological verification."}


def _dated_pairs(value: object) -> Iterator[tuple[dict, str, str]]:
    """(object, cause, effect) of every object that holds both dates, in order of the text, outer ones first."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if "cause_date" in v and "effect_date" in v:
                yield v, _shown(v["cause_date"]), _shown(v["effect_date"])
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)


def _shown(x: object) -> str:
    return x if isinstance(x, str) else json.dumps(x)


def _scrubbed(payload: str, bad: set[tuple[str, str]]) -> tuple[str, list[str]]:
    """The payload with every object of a bad pair of dates replaced, at any depth, and these pairs in order."""
    value: object = json.loads(payload)
    removed, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if "cause_date" in v and "effect_date" in v and (pair := (_shown(v["cause_date"]), _shown(v["effect_date"]))) in bad:
                removed.append(f"{pair[0]} -> {pair[1]}")
                v.clear()
                v.update(REMOVED)
            else:
                todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), removed


def scrub(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The rows with their JSON text scrubbed and a column removed, the "cause -> effect" texts of what went.

    An object at any depth that holds cause_date and effect_date, the effect before the cause, becomes REMOVED; its
    inside is not looked at. The order is that of the text. A null or broken text stays and loses nothing. The dates are
    judged by Spark's own rule, once for each pair of a row; the walk and the rewriting are Python in Arrow batches.
    """

    @F.pandas_udf("array<struct<cause: string, effect: string>>")
    def pairs(payloads: pd.Series) -> pd.Series:
        def of(p: str | None) -> list[dict]:
            found = _dated_pairs(_loaded(p)) if p is not None else ()
            return [{"cause": a, "effect": b} for a, b in dict.fromkeys((a, b) for _, a, b in found)]

        return payloads.map(of)

    @F.pandas_udf("struct<payload: string, removed: array<string>>")
    def rewritten(payloads: pd.Series, bad: pd.Series) -> pd.DataFrame:
        rows = [(p, []) if p is None or not len(b) else _scrubbed(p, {(x["cause"], x["effect"]) for x in b}) for p, b in zip(payloads, bad, strict=True)]
        return pd.DataFrame(rows, columns=["payload", "removed"])

    wrong = F.filter("_pairs", lambda x: F.coalesce(~chronology_ok(x["cause"], x["effect"]), F.lit(False)))
    done = df.withColumn("_pairs", pairs(F.col(payload))).withColumn("_bad", wrong).withColumn("_s", rewritten(F.col(payload), F.col("_bad")))
    return done.withColumns({payload: F.col("_s.payload"), "removed": F.col("_s.removed")}).drop("_pairs", "_bad", "_s")


def _loaded(payload: str) -> object:
    try:
        return json.loads(payload)
    except ValueError:
        return None


def apply_corrections(texts: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Wrong claims replaced by verified text, in order. corrections: (key, place, wrong, right)."""
    own = corrections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "wrong", "right"))).alias("c"))
    fixed = F.aggregate("c", F.col("text"), lambda t, c: F.replace(t, c["wrong"], c["right"]))
    out = texts.join(own, key, "left")
    return out.select(key, F.coalesce(fixed, F.col("text")).alias("text"), F.coalesce(F.size("c"), F.lit(0)).alias("n_corrections"))


def conflicts(df: DataFrame) -> DataFrame:
    """Findings of two agents that contradict each other. df: (ticker, cash_quality, severities, moat, tones).

    severities: of related-party and auditor flags; tones: the current tone of each shift.
    """
    severe = F.coalesce(F.exists("severities", lambda s: s.isin(*SEVERE)), F.lit(False))
    bearish = F.coalesce(F.exists("tones", lambda t: F.lower(t).contains("cautious") | F.lower(t).contains("challenging")), F.lit(False))
    found = F.array_compact(F.array(
        F.when((F.col("cash_quality") > 0.8) & severe, "forensic_quant, forensic_investigator: strong cash quality against severe flags"),
        F.when(F.upper("moat").isin("STRONG", "INTACT") & bearish, "moat_architect, narrative_decoder: intact moat against a worsening tone"),
    ))
    return df.select("ticker", F.array_join(found, "; ").alias("conflicts"), F.size(found).alias("n_conflicts"))


def rerun_needs(df: DataFrame) -> DataFrame:
    """Agents to run again, in order, once each. df: (ticker, severities, unrelated_acquisitions, n_governance_flags).

    severities: of related-party flags, auditor flags and contingent liabilities.
    """
    severe = F.coalesce(F.exists("severities", lambda s: s.isin(*SEVERE)), F.lit(False))
    needs = F.array_compact(F.array(
        F.when(severe, "forensic_quant"), F.when(F.col("unrelated_acquisitions"), "narrative_decoder"), F.when(F.col("n_governance_flags") >= 3, "forensic_investigator"),
    ))
    return df.select("ticker", F.array_join(needs, ",").alias("rerun"))


def evasion_score(items: DataFrame) -> DataFrame:
    """10, plus points by kind and level, within 0 to 100, with a verdict and counts. items: (ticker, kind, level).

    guidance: 15 for a credibility that says LOW, 7 for MEDIUM; shift: 10 for a significance that says HIGH, 5
    for MEDIUM; dodge: 8; phrase: 3. Guidance and shifts of other levels are not counted.
    """
    level, kind = F.upper(F.coalesce("level", F.lit(""))), F.col("kind")
    points = (
        F.when((kind == "guidance") & level.contains("LOW"), 15).when((kind == "guidance") & level.contains("MEDIUM"), 7)
        .when((kind == "shift") & level.contains("HIGH"), 10).when((kind == "shift") & level.contains("MEDIUM"), 5)
        .when(kind == "dodge", 8).when(kind == "phrase", 3).otherwise(0)
    )
    names = {"guidance": "guidance_misses", "shift": "tone_shifts", "dodge": "analyst_dodges", "phrase": "flagged_phrases"}
    counts = [F.sum(((kind == k) & (points > 0)).cast("int")).cast("int").alias(name) for k, name in names.items()]
    agg = items.groupBy("ticker").agg(*counts, F.sum(points).alias("_p"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 10 + F.col("_p"))).cast("int")
    verdict = F.coalesce(*[F.when(F.col("score") >= least, text) for least, text in EVASION_BANDS])
    return agg.withColumn("score", score).withColumn("verdict", verdict).drop("_p")


def flag_triage(flags: DataFrame) -> DataFrame:
    """Tickers with a severe flag fail for the reasons given; other flags warn. flags: (ticker, place, family, severity, text).

    Reasons and warnings stand in order of place, repeats included; a flag without a severity warns.
    """
    severe = F.coalesce(F.upper("severity").isin(*SEVERE), F.lit(False))
    line = F.struct("place", F.concat(F.upper("family"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, line))), lambda x: x["line"]), "; ")
    return flags.groupBy("ticker").agg((~F.bool_or(severe)).alias("passed"), text(severe).alias("kill_reasons"), text(~severe).alias("warnings"))


def ordered_summary(trails: DataFrame, order: tuple[str, ...] = AGENTS) -> DataFrame:
    """Trails numbered in the agents' fixed order, unknown ones last by name. trails: (ticker, agent, ...)."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, a in enumerate(order) for x in (a, k)]), F.col("agent")), F.lit(len(order)))
    return trails.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(rank, "agent")))


def trails_summary(trails: DataFrame, order: tuple[str, ...] = AGENTS) -> DataFrame:
    """One row a ticker: its agents in order with confidence, reasons (none: empty), findings and time, and the verdict.

    trails: (ticker, agent, confidence, reasons array<string>, findings JSON text, seconds). The verdict is read from
    the findings of pm_synthesis: recommendation, rationale and story, null where absent, and the two cases, empty where
    absent. Findings that are no object count as none.
    """
    findings = F.when(F.col("findings").rlike(r"^\s*\{.*[^{\s].*\}\s*$"), F.col("findings"))
    fields = [
        F.col("place"), F.col("agent"), F.col("confidence"), F.coalesce("reasons", F.array().cast("array<string>")).alias("confidence_reasons"),
        findings.alias("findings"), F.col("seconds").alias("execution_time_s"),
    ]
    rows = ordered_summary(trails, order).withColumn("t", F.struct(*fields)).withColumn("_pm", F.when(F.col("agent") == "pm_synthesis", findings))
    out = rows.groupBy("ticker").agg(F.array_sort(F.collect_list("t")).alias("trails"), F.max("_pm").alias("_pm"))
    text = lambda k: F.get_json_object("_pm", f"$.{k}")
    case = lambda k: F.coalesce(F.from_json(text(k), "array<string>"), F.array().cast("array<string>"))
    verdict = F.struct(
        text("recommendation").alias("recommendation"), text("recommendation_rationale").alias("recommendation_rationale"),
        text("stock_story").alias("stock_story"), case("bull_case").alias("positives"), case("bear_case").alias("negatives"),
    )
    return out.select("ticker", "trails", verdict.alias("verdict"))


#: Names that are written as they stand here, and words that are written in capitals.
NAMES = {"pm synthesis": "PM Synthesis", "bul case": "Bull Case", "bull case": "Bull Case", "reverse dcf": "Reverse DCF", "moat durability": "Moat Durability"}
CAPITALS = ("PM", "DCF", "ROIC", "OCF", "EBITDA", "USFDA", "ANDA", "CAGR", "KPI", "WACC", "FCF", "PAT")
_CAPITALS = re.compile(r"\b(?:" + "|".join(f"{w.title()}|{w.lower()}" for w in CAPITALS) + r")\b")


def _human(key: str) -> str:
    plain = key.replace("_", " ")
    return NAMES.get(plain.lower()) or _CAPITALS.sub(lambda m: m.group().upper(), plain.title())


def _absent(v: object) -> bool:
    return v is None or (isinstance(v, (list, dict)) and not v) or (isinstance(v, str) and v.strip().lower() in ("", "none"))


def _rendered(v: object) -> str:
    if _absent(v):
        return ""
    if isinstance(v, list):
        return " • ".join(filter(None, map(_rendered, v)))
    if not isinstance(v, dict):
        return str(v)
    if v.keys() & {"snippet", "doc_id", "chunk_id", "page"}:
        snippet, doc, page = (str(v.get("snippet") or "").strip(), str(v.get("doc_id") or "").strip(), v.get("page"))
        where = ", ".join([*filter(None, [doc]), *([] if page in (None, "", "None") else [f"p.{page}"])])
        return " ".join(filter(None, [snippet and f'"{snippet}"', where and f"— {where}"]))
    return "; ".join(f"{_human(k)}: {_rendered(x)}" for k, x in v.items() if not _absent(x))


def render_value(payload: Column) -> Column:
    """A JSON value of any depth as one line of text; null for a null or broken text.

    Objects of a citation give their quoted snippet and where it stands; other objects "Key: value" parts, lists their
    parts with a bullet between them. Nulls, blanks, the word none and empty values are left out.
    """

    @F.pandas_udf("string")
    def run(payloads: pd.Series) -> pd.Series:
        def line(p: str | None) -> str | None:
            try:
                return None if p is None else _rendered(json.loads(p))
            except ValueError:
                return None

        return payloads.map(line)

    return run(payload)


def run_quality(steps: DataFrame) -> DataFrame:
    """Depth, input completeness, tokens and time of each run. steps: (run_id, kind, ok, tokens, ms)."""
    calls = F.sum((F.col("kind") == "tool").cast("int"))
    failed = F.sum(((F.col("kind") == "memory") & ~F.col("ok")).cast("int"))
    depth = F.when(calls >= 6, "deep").when(calls >= 3, "moderate").when(calls >= 1, "shallow").otherwise("none")
    return steps.groupBy("run_id").agg(calls.cast("int").alias("tool_calls"), depth.alias("depth"), r(F.greatest(F.lit(0.0), 1 - 0.2 * failed), 2).alias("completeness"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"))
