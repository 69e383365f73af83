"""Registered queries of prices, ledgers and retrieval, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.exprs import r as rr
from ledgerloom.operators import ledger as M
from ledgerloom.operators import prices as P
from ledgerloom.operators import quant as Q
from ledgerloom.operators import retrieval as V
from ledgerloom.plans.q_core import R, WIDE
from ledgerloom.plans.registry import query
from ledgerloom.plans.tables import PRICES, VEC, oracle, relation, table
from ledgerloom.sources.shared import kept, new_folder
from ledgerloom.sources.store import ChunkStore

prices = lambda s, d: relation(s, d, "prices")
NOW = "2024-06-01"

# --- prices ----------------------------------------------------------------------------------------


@query("p1_weekly_closes", """with t as (select concat('S', l_suppkey) ticker, l_suppkey % 2 + l_linenumber % 2 venue_no, l_shipdate ts, l_orderkey o, l_linenumber n, l_extendedprice / l_quantity px from lineitem),
 w as (select ticker, venue_no, cast(date_trunc('week', ts) as date) dt, max_by(px, (ts, o, n)) close_px from t group by 1, 2, 3), e as (select *, count(*) over (partition by ticker, venue_no) c from w)
 select ticker, venue_no, dt, close_px from (select *, min(venue_no) over (partition by ticker) f from e where c >= 30) where venue_no = f""")
def p1(s, d):
    """Last price of each week at the first venue with enough weeks."""
    t = table(s, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), (F.col("l_suppkey") % 2 + F.col("l_linenumber") % 2).alias("venue_no"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("key"), F.col("l_shipdate").alias("at"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    # several trades of one day are told apart by order and line
    day = t.groupBy("ticker", "venue_no", F.col("at").alias("ts")).agg(F.max_by("px", "key").alias("px"))
    return P.weekly_closes(day)


_SWING = """, pts as (select ticker, dt, close_px px, row_number() over (partition by ticker order by dt) i, count(*) over (partition by ticker) n from prices),
 z as (select ticker, 1::bigint i, n, 0 dir, dt lo_dt, px lo, dt hi_dt, px hi, dt f_dt, px f_px, dt l_dt, px l_px, null::varchar kind, null::date s_dt, null::double s_px, null::date e_dt, null::double e_px from pts where i = 1 and n >= 8
 union all select z.ticker, p.i, z.n,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then 1 when p.px <= z.hi * 0.75e0 then -1 else 0 end when z.dir = 1 then case when p.px >= z.hi then 1 when p.px <= z.hi * 0.75e0 then -1 else 1 end else case when p.px <= z.lo then -1 when p.px >= z.lo * 1.25e0 then 1 else -1 end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then z.lo_dt when p.px <= z.hi * 0.75e0 or p.px < z.lo then p.dt else z.lo_dt end when z.dir = 1 then case when p.px <= z.hi * 0.75e0 then p.dt else z.lo_dt end else case when p.px <= z.lo then p.dt else z.lo_dt end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then z.lo when p.px <= z.hi * 0.75e0 or p.px < z.lo then p.px else z.lo end when z.dir = 1 then case when p.px <= z.hi * 0.75e0 then p.px else z.lo end else case when p.px <= z.lo then p.px else z.lo end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then p.dt when p.px <= z.hi * 0.75e0 then z.hi_dt when p.px > z.hi then p.dt else z.hi_dt end when z.dir = 1 then case when p.px >= z.hi then p.dt else z.hi_dt end else case when p.px >= z.lo * 1.25e0 then p.dt else z.hi_dt end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then p.px when p.px <= z.hi * 0.75e0 then z.hi when p.px > z.hi then p.px else z.hi end when z.dir = 1 then case when p.px >= z.hi then p.px else z.hi end else case when p.px >= z.lo * 1.25e0 then p.px else z.hi end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then z.lo_dt when p.px <= z.hi * 0.75e0 then z.hi_dt else z.f_dt end when z.dir = 1 then case when p.px <= z.hi * 0.75e0 then z.hi_dt else z.f_dt end else case when p.px >= z.lo * 1.25e0 then z.lo_dt else z.f_dt end end,
  case when z.dir = 0 then case when p.px >= z.lo * 1.25e0 then z.lo when p.px <= z.hi * 0.75e0 then z.hi else z.f_px end when z.dir = 1 then case when p.px <= z.hi * 0.75e0 then z.hi else z.f_px end else case when p.px >= z.lo * 1.25e0 then z.lo else z.f_px end end,
  p.dt, p.px,
  case when z.dir = 1 and p.px <= z.hi * 0.75e0 then 'rally' when z.dir = -1 and p.px >= z.lo * 1.25e0 then 'decline' end,
  z.f_dt, z.f_px, case when z.dir = 1 then z.hi_dt else z.lo_dt end, case when z.dir = 1 then z.hi else z.lo end
 from z join pts p on p.ticker = z.ticker and p.i = z.i + 1),
 eps as (select ticker, kind, s_dt "start", s_px a, e_dt "end", e_px b, false ongoing from z where kind is not null
 union all select ticker, case dir when 1 then 'rally' else 'decline' end, f_dt, f_px, l_dt, l_px, true from z where i = n and dir <> 0 and abs(l_px / f_px - 1) >= 0.125e0 and l_dt > f_dt),
 ep as (select ticker, kind, "start", """ + R("a", 2) + " start_px, \"end\", " + R("b", 2) + " end_px, " + R("(b / a - 1) * 100", 1) + """ change_pct, greatest(1, cast(round(("end" - "start") / 7) as int)) "weeks",
 cast(year("start") + case when month("start") >= 4 then 1 else 0 end as int) fy_start, cast(year("end") + case when month("end") >= 4 then 1 else 0 end as int) fy_end, ongoing from eps)"""
_EP = oracle("prices") + _SWING


def episodes(s, d):
    return P.swing_episodes(prices(s, d))


@query("p2_swing_episodes", _EP + " select * from ep")
def p2(s, d, threshold=0.25, min_points=8):
    """Zigzag episodes of every series."""
    return P.swing_episodes(prices(s, d), threshold, min_points)


@query("p3_asof_returns", oracle("prices") + """, e as (select ticker, max(dt) l, min(dt) f, max_by(close_px, dt) now, min_by(close_px, dt) fp from prices group by 1),
 a as (select e.*, """ + ", ".join(f"(select max_by(p.close_px, p.dt) from prices p where p.ticker = e.ticker and p.dt <= make_date(cast(year(l) - {n} as int), cast(month(l) as int), cast(least(day(l), 28) as int))) p{n}" for n in (1, 3, 5)) + """ from e)
 select ticker, """ + ", ".join(R(f"(now - coalesce(p{n}, case when l - f >= {360 * n} then fp end)) / coalesce(p{n}, case when l - f >= {360 * n} then fp end) * 100", 1) + f" return_{n}y" for n in (1, 3, 5)) + " from a")
def p3(s, d):
    """Returns over one, three and five years."""
    return P.asof_returns(prices(s, d))


@query("p4_high_52w", oracle("prices") + f", l as (select *, max(dt) over (partition by ticker) m from prices), h as (select ticker, max(close_px) h, max_by(close_px, dt) n from l where dt >= m - 365 group by 1) select ticker, {R('h', 2)} high_52w, {R('(1 - n / h) * 100', 1)} below_pct from h")
def p4(s, d):
    """Highest close of the last year."""
    return P.high_52w(prices(s, d))


@query("p5_top_episodes", _EP + """, k as (select * from ep qualify row_number() over (partition by ticker order by "start" desc) <= 6)
 select *, row_number() over (partition by ticker order by abs(change_pct) desc, "start" desc) <= 3 evidence from k""")
def p5(s, d):
    """The latest episodes, the largest marked."""
    return P.top_episodes(episodes(s, d))


@query("p6_episode_backdrop", WIDE + ", prices as (" + PRICES + ")" + _SWING + f""" select ep.ticker, kind, "start", "end", a.sales sales_a, b.sales sales_b, {R("(b.sales - a.sales) / nullif(abs(a.sales), 0) * 100", 1)} sales_change_pct, {R("(b.pat - a.pat) / nullif(abs(a.pat), 0) * 100", 1)} pat_change_pct
 from ep left join wide a on a.ticker = ep.ticker and a.period_year = fy_start left join wide b on b.ticker = ep.ticker and b.period_year = fy_end""")
def p6(s, d):
    """Sales and profit behind each episode."""
    return P.episode_backdrop(episodes(s, d), Q.wide(relation(s, d, "facts")))


@query("p8_year_end_price", oracle("prices") + """, y as (select ticker, yr, make_date(cast(yr as int), 3, 31) t from (select distinct ticker from prices), (select unnest(range(1995, 2004)) yr)),
 b as (select y.ticker, yr, t, max_by(close_px, dt) price, max(dt) price_dt from y left join prices p on p.ticker = y.ticker and p.dt between t - 35 and t group by 1, 2, 3)
 select ticker, cast(yr as int) period_year, price, price_dt, case when price_dt = t then 'exact' when t - price_dt <= 14 then 'within_14' when price_dt is not null then 'within_35' else 'none' end tier from b""")
def p8(s, d):
    """Closes at fiscal year ends."""
    p = prices(s, d)
    return P.year_end_price(p, p.select("ticker").distinct().withColumn("period_year", F.explode(F.sequence(F.lit(1995), F.lit(2003)))))


@query("p9_band_points", _EP + """ select p.ticker, p.dt, p.i::int place, min(e."start") band_start from pts p left join ep e on e.ticker = p.ticker and e."end" > e."start" and p.dt between e."start" and e."end" group by 1, 2, 3""")
def p9(s, d):
    """Points with the episode that covers them."""
    return P.band_points(prices(s, d), episodes(s, d))


# --- retrieval -------------------------------------------------------------------------------------

_COS = "coalesce(list_cosine_similarity(list_transform({0}, lambda x: cast(x as double)), list_transform({1}, lambda x: cast(x as double))), 0)"
_TOP = oracle("vec") + """, q as (select vec_id query_id, embedding qvec from vec where vec_id % 100 = 0), sc as (select q.query_id, v.*, """ + R(_COS.format("v.embedding", "q.qvec"), 3) + """ relevance from vec v, q),
 top as (select *, row_number() over (partition by query_id order by relevance desc, vec_id) place from sc where {where})"""


def _queries(s, d, *own):
    v = relation(s, d, "vec").where("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), *[F.col(c).alias(f"q_{c}") for c in own])


@query("r1_search", _TOP.format(where="doc_type in ('annual_report', 'credit_report') and cal_year >= 2022") + " select query_id, vec_id, relevance, place from top where place <= 5")
def r1(s, d):
    """Similar chunks under filters."""
    return V.search(relation(s, d, "vec"), _queries(s, d), 5, {"doc_type": ["annual_report", "credit_report"]}, 2022).select("query_id", "vec_id", "relevance", "place")


@query("r2_with_sentinel", _TOP.format(where="ticker = 'T3' and fiscal_year = 'FY25'") + ", h as (select query_id, vec_id, relevance, place from top where place <= 2) select q.query_id, h.vec_id, coalesce(relevance, 0) relevance, coalesce(place, 1) place, vec_id is not null found from q left join h using (query_id)")
def r2(s, d):
    """Queries without a hit have a row that says so."""
    q = _queries(s, d)
    hits = V.search(relation(s, d, "vec"), q, 2, {"ticker": "t3", "fiscal_year": "FY25"}).select("query_id", "vec_id", "relevance", "place")
    return V.with_sentinel(hits, q)


@query("r3_window_policy", """with r as (select event_id, case when event_id % 3 = 0 then 'Q1_FY25' end asked, event_id % 5 = 0 allp, case when event_id % 7 = 0 then 2022 end my, 'Q3_FY' || (24 + event_id % 3) act from events)
 select event_id request_id, asked as period, case when asked is null and not allp and my is null then ['FY' || (24 + event_id % 3), 'FY' || (23 + event_id % 3)] end as "years", case when asked is null then my end min_year from r""")
def r3(s, d):
    """Filters of requests."""
    e = F.col("event_id")
    r = table(s, d, "events").select(e.alias("request_id"), F.when(e % 3 == 0, "Q1_FY25").alias("asked_period"), (e % 5 == 0).alias("all_periods"), F.when(e % 7 == 0, 2022).alias("min_year"), F.concat(F.lit("Q3_FY"), (24 + e % 3).cast("string")).alias("active_period"))
    return V.window_policy(r)


_TEXTS = ", tx as (select vec_id, 'chunk text number ' || (vec_id % 40) || ' of the store' as text from embeddings)"


def _texts(s, d):
    return table(s, d, "embeddings").select("vec_id", F.concat(F.lit("chunk text number "), (F.col("vec_id") % 40).cast("string"), F.lit(" of the store")).alias("text"))


def _multi(key: str, n: int) -> str:
    return _TEXTS + f""", j as (select t.query_id, t.vec_id, t.place, t.relevance, tx.text from top t join tx using (vec_id) where place <= 3), f as (select * from j qualify row_number() over (partition by {key} order by query_id, place, vec_id) = 1)
 select 0 group_id, row_number() over (order by query_id, place, vec_id) n, query_id, vec_id, relevance, substr(text, 1, 1500) as text from f qualify n <= {n}"""


@query("r4_multi_query", _TOP.format(where="true") + _multi("md5(text)", 12))
def r4(s, d):
    """Hits of several queries without repeated texts."""
    return V.multi_query(V.search(relation(s, d, "vec"), _queries(s, d), 3), _texts(s, d))


@query("r6_segment_evidence", _TOP.format(where="true") + _multi("substr(text, 1, 19)", 10))
def r6(s, d):
    """The same with the first letters as key."""
    return V.multi_query(V.search(relation(s, d, "vec"), _queries(s, d), 3), _texts(s, d), 10, key_chars=19)


#: Vectors whose ids divisible by 100 fall on many companies.
_SPREAD = ", spread as (select * replace ('S' || (1 + vec_id % 97) as ticker) from vec)"


def _spread(s, d):
    return relation(s, d, "vec").withColumn("ticker", F.expr("concat('S', cast(1 + vec_id % 97 as string))"))


@query("r5_assemble", oracle("vec") + _SPREAD + _TEXTS + """, q as (select vec_id query_id, embedding qvec, ticker qt from spread where vec_id % 100 = 0), sc as (select q.query_id, v.vec_id, v.ticker, v.fiscal_year in ('FY22', 'FY24') narrow, """ + R(_COS.format("v.embedding", "q.qvec"), 3) + """ rel from spread v join q on q.qt = v.ticker),
 a as (select *, row_number() over (partition by query_id order by rel desc, vec_id) place from sc where narrow), b as (select *, row_number() over (partition by query_id order by rel desc, vec_id) place from sc where ticker not in (select ticker from a)),
 h as (select *, false w from a where place <= 5 union all select *, true from b where place <= 5)
 select ticker, count(*) n_chunks, bool_or(w) widened, md5(string_agg(text, chr(10) order by query_id, place, text)) text_md5 from h join tx using (vec_id) group by 1""")
def r5(s, d):
    """Texts of each ticker within a window, widened where it has none."""
    v = _spread(s, d).where("vec_id % 100 = 0")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("ticker").alias("q_ticker"))
    return V.assemble(_spread(s, d), asked, _texts(s, d), ["FY22", "FY24"])


@query("r7_store_stats", oracle("vec") + " select ticker, count(*) n_chunks, list_sort(list(distinct doc_type)) doc_types, list_sort(list(distinct fiscal_year)) fiscal_years from vec group by 1")
def r7(s, d):
    """Contents of the store."""
    return V.store_stats(relation(s, d, "vec"))


@query("r8_drop_failed", "select count(*) n_all, count(*) filter (where vec_id % 50 = 0) n_failed from embeddings")
def r8(s, d):
    """Vectors that failed."""
    v = relation(s, d, "vec").withColumn("embedding", F.when(F.col("vec_id") % 50 != 0, F.col("embedding")))
    return V.drop_failed(v)[1]


@query("r9_upsert_chunks", """select vec_id doc_id, case when vec_id % 3 = 0 then 'new' else 'old' end as state, cast(case when vec_id % 3 = 0 and vec_id % 5 <> 1 then 2 else 1 end as int) as version, len(embedding) as dims
 from embeddings where (vec_id % 5 <> 1 or vec_id % 3 = 0) and not (vec_id % 7 = 2 and vec_id % 3 <> 0)""")
def r9(s, d):
    """A stored set of chunks after a batch that replaces and adds, the same batch again, and the clearing of a ticker."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("t"), (F.col("vec_id") % 7).cast("string")).alias("ticker"), "embedding")
    store = ChunkStore(s, new_folder(s, "store"), 16)

    def put(rows, state):
        docs = rows.select("doc_id", "ticker", F.lit(state).alias("digest"))
        fresh = store.changed(docs)
        store.upsert(fresh, rows.join(fresh.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(state).alias("state"), F.size("embedding").cast("long").alias("dims")))

    put(v.where("doc_id % 5 <> 1"), "old")
    late = v.where("doc_id % 3 = 0").withColumn("ticker", F.lit("late"))
    put(late, "new")
    put(late, "new")
    store.clear("T2")
    store.vacuum()
    return store.chunks().join(store.documents().select("doc_id", "version"), "doc_id")


@query("r10_embed")
def r10(s, d):
    """Unit vectors of texts: how long they are."""
    e = V.embed(table(s, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("r11_band_pairs", "with p as (select a.label g, a.vec_id a_id, b.vec_id b_id, " + R(_COS.format("a.embedding", "b.embedding"), 4) + " similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id) select * from p where similarity between 0.3 and 0.92")
def r11(s, d):
    """Pairs of one label that are alike but not the same."""
    return V.band_pairs(table(s, d, "embeddings"), "label", 0.3, 0.92)


@query("r12_topic_search", oracle("vec") + """, q as (select vec_id no, embedding qvec from vec where vec_id % 100 = 0), asked as (select no || '-' || ticker query_id from q, (select distinct ticker from vec) union all select cast(no as varchar) from q),
 sc as (select q.no, v.ticker, v.vec_id, """ + R(_COS.format("v.embedding", "q.qvec"), 3) + """ relevance from vec v, q),
 top as (select *, row_number() over (partition by no, ticker order by relevance desc, vec_id) place from sc),
 h as (select no || '-' || ticker query_id, vec_id, relevance, place from top where place <= case no % 400 when 0 then 5 else 3 end)
 select query_id, h.vec_id, coalesce(relevance, 0) relevance, coalesce(place, 1) place, vec_id is not null found from asked left join h using (query_id)""")
def r12(s, d):
    """Topics of all domains searched in all chunks: every stated query asks every ticker of the store, and once none."""
    v, e = relation(s, d, "vec"), F.col("no")
    domain = F.when(e % 400 == 0, "guidance").when(e % 400 == 100, "competitive").when(e % 400 == 200, "capital").otherwise("governance")
    stated = _queries(s, d).withColumnRenamed("query_id", "no").withColumn("domain", domain)
    asked = stated.crossJoin(v.select("ticker").distinct()).unionByName(stated.withColumn("ticker", F.lit(None).cast("string")))
    asked = asked.withColumn("query_id", F.concat_ws("-", e.cast("string"), "ticker"))
    return V.topic_search(v, asked).select("query_id", "vec_id", "relevance", "place", "found")


@query("r12_topic_passages", r"""with c as (select doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) doc from documents), p0 as (select doc_id, string_split_regex(doc, '\n\s*\n') ps from c),
 p as (select doc_id, unnest(range(0, len(ps))) i, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') p from p0),
 q as (select *, cast((length(p) - length(replace(lower(p), 'ing', ''))) / 3 as int) + cast((length(p) - length(replace(lower(p), 'tion', ''))) / 4 as int) score from p where length(p) >= 30),
 b as (select *, row_number() over (partition by doc_id order by score desc, i) place from q where score > 0 qualify place <= 3)
 select c.doc_id query_id, coalesce(place, 1) place, coalesce(substr(p, 1, 800), 'Not found') passage, coalesce(score, 0) score from c left join b using (doc_id)""")
def r12b(s, d):
    """Topics searched in texts of their own, where no ticker is named."""
    doc = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return V.topic_passages(table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.lit("ing of tion").alias("topic"), doc.alias("doc")))


@query("p7_episode_evidence", WIDE.replace("with recursive", "with recursive vec as (" + VEC + "),") + ", prices as (" + PRICES + ")" + _SWING + """, q as (select vec_id query_id, embedding qvec from vec where vec_id % 100 = 0),
 k as (select *, row_number() over (partition by ticker order by "start" desc) n from ep), w as (select ticker, "start", 'FY' || (22 + fy_end % 5) fy, 'T' || (cast(substr(ticker, 2) as int) % 10) t from k where n <= 2),
 sc as (select query_id, v.ticker t, v.fiscal_year fy, v.vec_id, """ + R(_COS.format("v.embedding", "q.qvec"), 3) + """ rel from vec v, q where v.doc_type in ('annual_report', 'concall_transcript')),
 best as (select *, row_number() over (partition by query_id, t, fy order by rel desc, vec_id) place from sc qualify place <= 2)
 select query_id, w.ticker, w."start", vec_id, rel relevance, place from w join best using (t, fy)""")
def p7(s, d):
    """Chunks of the years of each recent episode, for every search query: one search for each company and year that an episode has."""
    ep = P.top_episodes(episodes(s, d), 2)
    company = F.concat(F.lit("T"), (F.substring("ticker", 2, 9).cast("int") % 10).cast("string"))
    w = ep.select("ticker", "start", F.concat(F.lit("FY"), (22 + F.col("fy_end") % 5).cast("string")).alias("q_fiscal_year"), company.alias("q_ticker"))
    chunks = relation(s, d, "vec").where("doc_type in ('annual_report', 'concall_transcript')").select("vec_id", "ticker", "fiscal_year", "embedding")
    asked = w.select("q_ticker", "q_fiscal_year").distinct().crossJoin(_queries(s, d))  # the stated queries for each pair
    asked = asked.withColumn("no", F.col("query_id")).withColumn("query_id", F.concat_ws("-", F.col("no").cast("string"), "q_ticker", "q_fiscal_year"))
    hits = V.search(chunks, asked, 2).select(F.col("no").alias("query_id"), F.col("ticker").alias("q_ticker"), F.col("fiscal_year").alias("q_fiscal_year"), "vec_id", "relevance", "place")
    return w.join(hits, ["q_ticker", "q_fiscal_year"]).select("query_id", "ticker", "start", "vec_id", "relevance", "place")


# --- ledgers ---------------------------------------------------------------------------------------

led = lambda s, d: relation(s, d, "ledger")
_L = oracle("ledger")
_HALF = "id % 2 = 0"


@query("m1_upsert", _L + """, t as (select ticker, fiscal_period, agent_name, 'p' || max(id) payload, max(run_date) saved_at, min(run_date) created_at from ledger where id % 2 = 0 group by 1, 2, 3), b as (select ticker, fiscal_period, agent_name, 'n' || max(id) payload, max(run_date) saved_at, min(run_date) created_at from ledger where id % 3 = 0 group by 1, 2, 3)
 select coalesce(b.ticker, t.ticker) ticker, coalesce(b.fiscal_period, t.fiscal_period) fiscal_period, coalesce(b.agent_name, t.agent_name) agent_name, coalesce(b.payload, t.payload) payload, coalesce(b.saved_at, t.saved_at) saved_at, coalesce(t.created_at, b.created_at) created_at from t full join b on t.ticker = b.ticker and t.fiscal_period = b.fiscal_period and t.agent_name = b.agent_name""")
def m1(s, d):
    """Reports by ticker, period and agent after a batch."""
    cut = lambda cond, p: led(s, d).where(cond).groupBy("ticker", "fiscal_period", "agent_name").agg(F.concat(F.lit(p), F.max("id").cast("string")).alias("payload"), F.max("run_date").alias("saved_at"), F.min("run_date").alias("created_at"))
    return M.upsert(cut(_HALF, "p"), cut("id % 3 = 0", "n"), ("ticker", "fiscal_period", "agent_name"), "saved_at", ("created_at",))


@query("m2_lookup", _L + ", l as (select upper(ticker) ticker, max_by(original_claim, (run_date, id)) payload, max(run_date) saved_at from ledger group by 1), q as (select distinct upper(lower(ticker)) ticker from ledger union all select 'NONE') select q.ticker, payload, saved_at from q left join l using (ticker)")
def m2(s, d):
    """The latest payload of each ticker asked for."""
    t = led(s, d).withColumns({"payload": F.col("original_claim")}).groupBy("ticker", "run_date").agg(F.max_by("payload", "id").alias("payload"))
    q = led(s, d).select(F.lower("ticker").alias("ticker")).distinct().union(s.createDataFrame([("none",)], "ticker string"))
    return M.lookup(t, q, "ticker", "run_date")


@query("m3_guidance_digest", _L + """, a as (select *, row_number() over (partition by ticker order by run_date desc, id desc) k from ledger where metric_category = 'guidance'), b as (select *, row_number() over (partition by ticker order by run_date desc, id desc) j from a where k <= 12 and fiscal_period <> 'Q1_FY24'),
 c as (select ticker, count(*) n, count(*) filter (where score < 40) l from b where j <= 10 group by 1) select ticker, n n_shown, l n_low, l >= 2 fires from c""")
def m3(s, d):
    """Credibility of guidance."""
    track = led(s, d).where("metric_category = 'guidance'").select("ticker", "id", "fiscal_period", F.col("run_date").alias("created_at"), F.when(F.col("score") < 40, "LOW").otherwise("HIGH").alias("credibility"))
    return M.guidance_digest(track, "Q1_FY24")


def _verdicts(s, d):
    rec = F.element_at(F.array(*map(F.lit, ("BUY", "SELL", "HOLD", ""))), (F.col("score") % 4 + 1).cast("int"))
    w = led(s, d).withColumn("rec", rec)
    return w.groupBy(F.concat(F.lit("S"), F.regexp_replace("ticker", "E", "")).alias("ticker"), "fiscal_period").agg(F.max_by("rec", "id").alias("recommendation"), F.max_by(F.col("score") + 900.0, "id").alias("price"), F.lit("1998-06-01").cast("timestamp").alias("published_at"), F.lit(None).cast("double").alias("eval_90"), F.lit(None).cast("double").alias("eval_180"))


_VER = _L + """, ver as (select concat('S', replace(ticker, 'E', '')) ticker, fiscal_period, max_by(case score % 4 when 0 then 'BUY' when 1 then 'SELL' when 2 then 'HOLD' else '' end, id) recommendation, max_by(score + 900.0e0, id) price, timestamp '1998-06-01' published_at from ledger group by 1, 2)"""


@query("m4_record_thesis", _VER + " select ticker, fiscal_period, case when fiscal_period like 'Q1%' and recommendation <> '' then recommendation else 'OLD' end recommendation, case when fiscal_period like 'Q1%' and recommendation <> '' then null else 1.0e0 end eval_90 from ver")
def m4(s, d):
    """Verdicts rewritten: their evaluations are cleared."""
    v = _verdicts(s, d)
    old = v.withColumns({"recommendation": F.lit("OLD"), "eval_90": F.lit(1.0)})
    return M.record_thesis(old, v.where("fiscal_period like 'Q1%'")).select("ticker", "fiscal_period", "recommendation", "eval_90")


@query("m5_pending", _VER + " select ticker, fiscal_period from ver where fiscal_period not like 'Q2%'")
def m5(s, d):
    """Verdicts to be scored."""
    v = _verdicts(s, d).withColumn("eval_90", F.when(F.col("fiscal_period").like("Q2%"), 1.0))
    return M.pending(v, 90, F.lit(NOW).cast("date")).select("ticker", "fiscal_period")


_SCORED = ", prices as (" + PRICES + "), sx as (select v.ticker, fiscal_period, recommendation, price, max_by(close_px, dt) px from ver v join prices p on p.ticker = v.ticker and dt <= date '1998-06-01' + 90 group by 1, 2, 3, 4), sm as (select *, " + R("(px - price) / price * 100", 2) + " move_pct from sx), ss as (select ticker, fiscal_period, recommendation, move_pct, case when recommendation in ('ADD', 'BUY') then move_pct > 0 when recommendation in ('SELL', 'SHORT') then move_pct < 0 else abs(move_pct) <= 10 end hit from sm)"


@query("m6_score_verdicts", _VER + _SCORED + " select * from ss")
def m6(s, d):
    """Verdicts against prices."""
    return M.score_verdicts(_verdicts(s, d), prices(s, d), 90)


@query("m7_track_record", _VER + _SCORED + ", k as (select * from ss qualify row_number() over (partition by ticker order by fiscal_period desc) <= 6) select ticker, count(*) n, count(hit) n_scored, " + R("avg(case when hit then 1.0e0 else 0e0 end)", 2) + " hit_rate from k group by 1")
def m7(s, d):
    """How often the latest verdicts held."""
    return M.track_record(M.score_verdicts(_verdicts(s, d), prices(s, d), 90).withColumn("published_at", F.lit("1998-06-01").cast("date")))


@query("m8_append_corrections", _L + """, n as (select * from ledger where id % 3 = 0 and id % 2 = 1 qualify row_number() over (partition by ticker, agent_name, fiscal_period, original_claim order by id) = 1)
 select id, ticker, original_claim, case when verified_fact like 'UNVERIFIABLE%' then 0.5e0 else confidence end confidence from n where (ticker, agent_name, fiscal_period, original_claim) not in (select (ticker, agent_name, fiscal_period, original_claim) from ledger where id % 2 = 0)""")
def m8(s, d):
    """New corrections only."""
    return M.append_corrections(led(s, d).where(_HALF), led(s, d).where("id % 3 = 0 and id % 2 = 1")).select("id", "ticker", "original_claim", "confidence")


def _gaps(s, d):
    """Gaps as agents report them: some without a category, a period or a text."""
    k, text = F.col("id") % 11, F.concat(F.lit(" capex "), F.col("original_claim"))
    return M.gap_rows(led(s, d).where("score < 50").select(
        F.lower("ticker").alias("ticker"), "agent_name", F.when(k == 3, " ").otherwise(F.col("metric_category")).alias("category"),
        F.when(k == 5, None).otherwise(F.col("fiscal_period")).alias("fiscal_period"), F.when(k == 7, " ").otherwise(text).alias("description"), F.col("run_date").alias("seen"), "id",
    ))


_G = _L + """, gap as (select ticker, agent_name, case when id % 11 = 3 then 'capex' else metric_category end category, case when id % 11 = 5 then 'UNKNOWN' else fiscal_period end fiscal_period,
 'capex ' || original_claim description, run_date seen, id from ledger where score < 50 and id % 11 <> 7),
 gaps as (select ticker, agent_name, category, fiscal_period, count(*) n, min(seen) first_seen, max(seen) last_seen, min_by(description, (seen, id)) description, min_by(id, (seen, id)) id from gap group by 1, 2, 3, 4)"""


@query("m9_upsert_gaps", _G + " select * from gaps")
def m9(s, d):
    """Gaps counted over two loads."""
    none = _gaps(s, d).where("false")
    return M.upsert_gaps(M.upsert_gaps(none, _gaps(s, d).where(_HALF)), _gaps(s, d).where("not " + _HALF))


@query("m10_agent_patterns", _L + " select agent_name, id, confidence, run_date from ledger where confidence >= 0.7 qualify row_number() over (partition by agent_name order by confidence desc, run_date desc, id desc) <= 5")
def m10(s, d):
    """Best runs of each agent."""
    return M.agent_patterns(led(s, d).withColumn("tools", F.array("metric_category", "fiscal_period"))).select("agent_name", "id", "confidence", "run_date")


_CON = _L + """, lv as (select l.*, e.embedding v from ledger l join embeddings e on e.vec_id = l.id where verified_fact not like 'UNVERIFIABLE%'), pr as (select distinct n.ticker, n.metric_category, case when n.fiscal_period <= o.fiscal_period then n.id else o.id end a_id, case when n.fiscal_period <= o.fiscal_period then o.id else n.id end b_id, """ + R(_COS.format("n.v", "o.v"), 4) + """ similarity
 from lv n join lv o on n.ticker = o.ticker and n.metric_category = o.metric_category and n.fiscal_period <> o.fiscal_period and n.id <> o.id where n.id % 2 = 1 and o.id % 2 = 0),
 cp as (select * from pr where similarity between 0.1 and 0.92 and not (a_id % 10 = 0 or b_id % 10 = 0))"""


def _contradictions(s, d):
    rows = led(s, d)
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    alike = kept(M.alike_pairs(rows.where("id % 2 = 1"), rows.where(_HALF), vectors, 0.1, 0.92))  # read as pairs and as links
    return M.unlinked(alike, alike.where("a_id % 10 = 0 or b_id % 10 = 0"))


@query("m11_contradiction_pairs", _CON + " select * from cp")
def m11(s, d):
    """Claims that may contradict each other."""
    return _contradictions(s, d)


@query("m12_persist_contradictions", _CON + " select a_id, b_id, case when a_id % 4 = 0 then 'NUMBER' else 'REASON_DRIFT' end kind, 'MEDIUM' severity, 'since ' || b_id rationale from cp where a_id % 3 <> 0 and b_id % 7 <> 0")
def m12(s, d):
    """Contradictions kept."""
    pairs = kept(_contradictions(s, d).select("a_id", "b_id", "similarity"))
    verdicts = pairs.select("a_id", "b_id", F.when(F.col("a_id") % 3 != 0, "CONTRADICTION").otherwise("CONSISTENT").alias("label"), F.when(F.col("a_id") % 4 == 0, "NUMBER").alias("kind"), F.lit(None).cast("string").alias("severity"), F.concat(F.lit("since "), F.col("b_id").cast("string")).alias("rationale"))
    return M.persist_contradictions(pairs.where("b_id % 7 = 0"), pairs, verdicts)


@query("m13_memory_block", _L + f""", st as (select *, case score % 3 when 0 then 'NUMBER' when 1 then 'PERIOD' else 'SOURCE' end correction_type from ledger),
 q0 as (select distinct agent_name, ticker, case when agent_name = 'view' then fiscal_period end want from ledger union select 'view', 'NEW', null),
 lp as (select ticker, max_by(fiscal_period, (run_date, id)) period from st group by 1), q as (select agent_name, q0.ticker, coalesce(want, period) period from q0 left join lp using (ticker)),
 f as (select q.agent_name, q.ticker, q.period, verified_fact, run_date, id from q join st on st.agent_name = q.agent_name and st.ticker = q.ticker and st.fiscal_period = q.period where confidence >= 0.8
  qualify row_number() over (partition by q.agent_name, q.ticker, q.period order by run_date desc, id desc) <= 4), ft as (select agent_name, ticker, period, string_agg(verified_fact, '; ' order by run_date desc, id desc) t from f group by 1, 2, 3),
 gp as (select agent_name, ticker, fiscal_period period, metric_category category, count(*) n, min(id) id from ledger where score < 50 group by 1, 2, 3, 4), g as (select * from gp qualify row_number() over (partition by agent_name, ticker, period order by n desc, id) <= 5),
 gt as (select agent_name, ticker, period, string_agg(category, ',' order by n desc, id) t from g group by 1, 2, 3),
 pc as (select agent_name, correction_type, count(*) n from st where run_date >= date '{NOW}' - 180 and confidence >= 0.8 group by 1, 2), pt as (select agent_name, sum(n) total, string_agg(n || 'x ' || correction_type, ', ' order by n desc, correction_type) mix from pc group by 1)
 select q.agent_name, q.ticker, q.period, coalesce(ft.t, '') facts, coalesce(gt.t, '') gaps, case when total >= 5 then mix else '' end pattern, q.period is null warning
 from q left join ft on ft.agent_name = q.agent_name and ft.ticker = q.ticker and ft.period = q.period left join gt on gt.agent_name = q.agent_name and gt.ticker = q.ticker and gt.period = q.period left join pt on pt.agent_name = q.agent_name""")
def m13(s, d):
    """What an agent remembers of a ticker and a period; the latest period where none is asked for."""
    rows = led(s, d)
    kind = F.when(F.col("score") % 3 == 0, "NUMBER").when(F.col("score") % 3 == 1, "PERIOD").otherwise("SOURCE")
    gaps = rows.where("score < 50").groupBy("agent_name", "ticker", "fiscal_period", F.col("metric_category").alias("category")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = rows.select("agent_name", "ticker", F.when(F.col("agent_name") == "view", F.col("fiscal_period")).alias("fiscal_period")).distinct()
    new = asked.limit(1).select(F.lit("view").alias("agent_name"), F.lit("NEW").alias("ticker"), F.lit(None).cast("string").alias("fiscal_period"))
    return M.memory_block(rows.withColumn("correction_type", kind), gaps, asked.union(new), F.lit(NOW).cast("date"))


@query("m14_audit_trail", _L + " select id, ticker, cast(1 + id % 2 as int) n_citations, case id % 2 when 0 then 'D' || score || ' p.' || (id % 50) else 'D' || score || ' p.' || (id % 50) || '; E p.1' end citation_line from ledger where id % 100 = 0 or id % 100 = 1")
def m14(s, d):
    """Records with their citations."""
    one = F.concat(F.lit('{"doc":"D'), F.col("score").cast("string"), F.lit('","page":'), (F.col("id") % 50).cast("string"), F.lit("}"))
    rows = led(s, d).withColumn("citations", F.concat(F.lit("["), one, F.when(F.col("id") % 2 == 1, ',{"doc":"E","page":1}').otherwise(""), F.lit("]")))
    return M.audit_trail(rows, rows.where("id % 100 in (0, 1)").select("id"))


@query("m15_thesis_drift", _L + ", a as (select * from ledger where metric_category = 'margins' and verified_fact not like 'UNVERIFIABLE%' qualify row_number() over (partition by ticker order by fiscal_period, run_date, id) <= 8) select ticker, fiscal_period, id, verified_fact from a qualify row_number() over (partition by ticker, fiscal_period order by run_date, id) = 1")
def m15(s, d):
    """How a story changed."""
    return M.thesis_drift(led(s, d), "margins")


@query("m16_silent_gaps", _G + """ select ticker, category, cast(count(distinct fiscal_period) as int) n_periods, array_to_string(list_sort(list(distinct fiscal_period)), ',') periods,
 cast(sum(n) as bigint) total, max(last_seen) last_seen, max_by(description, (last_seen, id)) description from gaps group by 1, 2 having count(distinct fiscal_period) >= 2""")
def m16(s, d):
    """Gaps that come again."""
    return M.silent_gaps(M.upsert_gaps(_gaps(s, d).where("false"), _gaps(s, d)))


@query("m17_inconsistencies", _CON + " select a_id, b_id, a.fiscal_period period_a, a.verified_fact text_a, b.fiscal_period period_b, b.verified_fact text_b from cp left join (select * from ledger where id % 9 <> 0) a on a.id = a_id left join (select * from ledger where id % 9 <> 0) b on b.id = b_id")
def m17(s, d):
    """Pairs with both records."""
    return M.inconsistencies(led(s, d).where("id % 9 <> 0"), kept(_contradictions(s, d).select("a_id", "b_id")))


@query("m18_ledger_stats", _G + " select 'ledger' table_name, (select count(*) from ledger) n union all select 'gaps', (select count(*) from gaps)")
def m18(s, d):
    """Rows of the ledgers."""
    return M.ledger_stats(ledger=led(s, d), gaps=M.upsert_gaps(_gaps(s, d).where("false"), _gaps(s, d)))


@query("m19_align_schema", "select event_id, event_type, 'none' as status, 0.5e0 as weight from events")
def m19(s, d):
    """Columns added with defaults."""
    return M.align_schema(table(s, d, "events").select("event_id", "event_type"), {"event_type": ("string", "x"), "status": ("string", "none"), "weight": ("double", 0.5)})

