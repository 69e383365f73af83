"""The registered queries of the numbered operators, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_stream, cover_tree, exact_dedup, fill_middle, licenses, packing, pii, sharding, simhash, spelling
from ledgerloom.llm import substrings, token_counts, toxicity
from ledgerloom.llm.common import read_table

#: Bytes of a shard in the registered query.
SHARD_BYTES = 256 * 1024


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 4096)


def op3_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(read_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(read_table(spark, sf_dir, "embeddings"), 0.95)


def batch_of(id_name: str = "doc_id"):
    """Half of the rows, by a hash of their id, stand for the new batch; the others for the snapshot."""
    return F.pmod(F.xxhash64(id_name), F.lit(2)) == 1


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), batch_of())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), 2, 3)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic", 0.3)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"), min_length=6, min_count=5, every=199, ratio=5)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeated_passages(read_table(spark, sf_dir, "documents"), 13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.fill_in_middle(read_table(spark, sf_dir, "documents"), seed=42, percent=50, spm_percent=80))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_sharding, op2_packing, op3_bpe_stream, op4_token_counts, op5_cover_tree, op6_exact_dedup, op7_simhash)
    return {f.__name__: f for f in (*first, op8_licenses, op9_toxicity, op10_pii, op11_spelling, op12_substrings, op13_fill_middle)}


_OP1 = f"""
with d as (select doc_id, strlen(coalesce(text, '')) as n_bytes,
           lpad(bin(('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(0))), 1, 8))::bigint), 32, '0') as path from documents),
s as (select k as depth, substr(path, 1, k) as shard_id, sum(n_bytes) as shard_bytes, count(*) as shard_rows
      from d, (select unnest(range(0, 33)) as k) group by 1, 2),
f as (select d.doc_id, d.path, min(s.depth) as depth from d join s on substr(d.path, 1, s.depth) = s.shard_id
      where s.shard_bytes <= {SHARD_BYTES} or s.shard_rows = 1 group by all)
select d.doc_id, s.shard_id, cast(s.depth as int) as depth, d.n_bytes, s.shard_rows, cast(s.shard_bytes as bigint) as shard_bytes
from d join f on f.doc_id = d.doc_id join s on s.depth = f.depth and substr(d.path, 1, s.depth) = s.shard_id
"""

_OP5 = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_cosine_similarity(a.e, b.e) >= 0.95e0),
r as (select vec_id as a, vec_id as c from v union select l.b, r.c from r join l on l.a = r.a where r.c < l.b),
m as (select a, min(c) as c from r group by a),
n as (select a, count(*) as n from l group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, coalesce(m.c, e.vec_id) as component_id, coalesce(m.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join m on m.a = e.vec_id
"""

_OP6 = """
with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(g.t) as text_sha256
from documents d join g on coalesce(d.text, '') = g.t
"""


def _op8_sql() -> str:
    """Brute force: every place of a template's words as the start of a block; every word of a text against every phrase."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"('{k}', {len(v.split())}, list_distinct(string_split('{v}', ' ')))" for k, v in licenses.TEMPLATES.items())
    phrases = ", ".join(f"('{k}', '{v}')" for k, v in licenses.PHRASES.items())
    need = f"ceil({licenses.THRESHOLD} * len(tw) - 1e-9)"
    return rf"""
with d as (select doc_id, row_number() over () as r, lower(coalesce(text, '')) as t from documents),
w as (select doc_id, r, list_filter(regexp_split_to_array(t, '{gap}'), lambda x: x <> '') as ws from d),
p(phrase, label) as (values {phrases}),
hit as (select r, label, i from (select r, label, string_split(phrase, ' ') as pw, ws, unnest(range(0, len(ws))) as i from w, p
        where contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ')) where ws[i + 1 : i + len(pw)] = pw),
base as (select r, count(*) as n_base, min(i) as a, max(i) as b, list(distinct label) as labels from hit group by r),
tpl(label, n, tw) as (values {values}),
paras as (select r, unnest(regexp_split_to_array(t, '\n[ \t\r]*\n')) as l from d),
pw as (select r, row_number() over () as q, list_filter(regexp_split_to_array(l, '{gap}'), lambda x: x <> '') as lws from paras),
may as (select r, q, lws, label, n, tw from pw, tpl where len(list_intersect(lws, tw)) >= {need}),
blocks as (select r, label, tw, lws[s : s + n - 1] as b from (select *, unnest(range(1, greatest(1, len(lws) - n + 1) + 1)) as s from may)),
sim as (select r, label, len(list_intersect(b, tw)) / cast(len(tw) as double) as c from blocks where len(list_intersect(b, tw)) >= {need}),
more as (select r, list(distinct label) as labels, max(c) as c from sim group by r)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, a as first_word, b as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0e0 else coalesce(c, 0.0e0) end as score
from w left join base using (r) left join more using (r)
"""


#: The checksum by its table of 256 steps, made by rule; words one edit apart by the patterns that they share.
_OP11 = """
with recursive bit(k, c, i) as (
  select k::bigint, k::bigint, 0 from range(0, 256) as r(k)
  union all select k, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bit where i < 8),
steps as (select list(c order by k) as tab from bit where i = 8),
runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
bytes as (select run, hex(encode(doc_id || ':' || run)) as hx from runs where length(run) >= 6),
sums as (select run, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::bigint)),
         lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) as h from bytes, steps),
words as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from sums),
w as (select word, count(*) as n from words where length(word) >= 6 group by 1 having count(*) >= 5),
spot as (select word, n, unnest(range(0, length(word))) as i from w),
pat as (select word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) as swapped, substr(word, 1, i) || substr(word, i + 2) as cut from spot),
ins as (select distinct p.word as a, p.n as na, w.word as b, w.n as nb from pat p join w on w.word = p.cut),
near as (select p.word as a, q.word as b, q.n as nb from pat p join pat q on p.swapped = q.swapped and p.word <> q.word
         union all select a, b, nb from ins union all select b, a, na from ins),
best as (select a, count(*) as n_near, first(b order by nb desc, b) as b, max(nb) as nb from near group by a),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when nb >= 5 * n then b end as form, case when nb >= 5 * n then nb end as form_n from w left join best on a = w.word),
up(word, root) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.root where f.form is not null),
ends as (select up.word, up.root from up join f on f.word = up.root where f.form is null)
select f.word, form, root, n, n_near, form_n from f join ends using (word)
"""

_OP12 = r"""
with d as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
spot as (select doc_id, r, ws, unnest(range(1, len(ws) - 11)) as i from d),
win as (select doc_id, r, i, array_to_string(ws[i:i + 12], ' ') as t from spot),
late as (select r, i from (select doc_id, r, i, min(doc_id) over (partition by t) as least from win) where doc_id > least),
gone as (select r, list(distinct p) as ps from (select r, unnest(range(i, i + 13)) as p from late) group by r)
select doc_id, len(ws) as n_words, coalesce(len(ps), 0) as n_removed,
  sha256(case when ps is null then array_to_string(ws, ' ') else array_to_string(list_filter(ws, lambda x, k: not list_contains(ps, k)), ' ') end) as kept_sha256
from d left join gone using (r)
"""

_OP13 = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as us,
      ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from d),
f as (select *, len(us) as n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b from u),
p as (select *, array_to_string(us[1:a], '') as p, array_to_string(us[a + 1:b], '') as m, array_to_string(us[b + 1:], '') as s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    later = {"op11_spelling": _OP11, "op12_substrings": _OP12, "op13_fill_middle": _OP13}
    return {"op1_sharding": _OP1, "op5_cover_tree": _OP5, "op6_exact_dedup": _OP6, "op8_licenses": _op8_sql(), **later}
