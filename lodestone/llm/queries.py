"""The queries of this subpackage: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, license, neardup, packing, quality, tokencounts, topk, urlfilter, warc
from .common import read_table, scratch_path

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), 10, 100)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read_table(spark, sf_dir, "pages"), least=0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents as one batch of inserts, commits it again (to no effect) and
    returns the totals."""
    counts = tokencounts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(), "byte_bpe_50k")
    rollup = tokencounts.TokenRollup(spark, scratch_path(spark, "rollup"))
    for _ in range(2):
        rollup.commit("load", tokencounts.inserts(counts))
    return rollup.totals()


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), 85, 100)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_ALL = (op1_packing, op2_exact_topk, op3_url_filter, op4_chat_format, op5_license_scan, op6_warc, op7_decontamination, op8_token_counts, op9_minhash_dedup, op10_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from s)
select query_id, rk::int as rank, vec_id, score from r where rk <= 10
"""

_WARC = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, strlen(h) as payload_bytes, sha1(h) as x from p
), e as (
  select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 4), lambda i: array_to_string(list_transform(range(0, 8), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 10 * i::int, 10))::bigint >> (35 - 5 * j::int)) & 31)::int, 1)), '')), '') as payload_digest
  from d
), g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as last_id from e)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = last_id then 'response' else 'revisit' end as record_type,
  case when page_id = last_id then null else last_id end as refers_to
from g
"""

_NEAR = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w
), n as (select doc_id, count(*) as n from s group by doc_id),
i as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all
), e as (
  select i.a, i.b from i join n x on i.a = x.doc_id join n y on i.b = y.doc_id where 100 * i >= 85 * (x.n + y.n - i)
), r(doc_id, c) as (select doc_id, doc_id from documents union select e.b, r.c from r join e on r.doc_id = e.a),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from documents d join m on m.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
"""


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    phrases = ", ".join(f"('{text}', '{label}')" for text, label in license.PHRASES)
    grams = ", ".join(f"('{words}', {n}, '{label}', {size}, {j}, {covers}, {bits}, {every})" for _, words, n, label, size, j, covers, bits, every in license._template_grams(license.TEMPLATES, license.K))
    k = license.K
    return f"""
with w as (select row_number() over () as uid, doc_id, {_WORDS} as ws from documents),
p as (select string_split(t, ' ') as ps, label from (values {phrases}) v(t, label)),
places as (
  select uid, label, i from (select uid, label, ps, ws, unnest(range(1, len(ws) - len(ps) + 2)) as i from w cross join p) where ws[i:i + len(ps) - 1] = ps
), base as (
  select uid, count(*) as n, min(i) - 1 as lo, max(i) - 1 as hi, array_to_string(list_sort(list(distinct label)), ',') as labels from places group by uid
), tg as (select * from (values {grams}) v(gram, n, label, size, j, covers, bits, every)),
dg as (select uid, i, array_to_string(ws[i:i + {k - 1}], ' ') as gram from (select uid, ws, unnest(range(1, len(ws) - {k - 2})) as i from w)),
votes as (select distinct uid, n, label, size, every, i - j as d, j, covers, bits from dg join tg using (gram)),
lines as (select *, case when d - lag(d) over (partition by uid, n order by d) <= {license.SLACK} then 0 else 1 end as fresh from (select distinct uid, n, d from votes)),
spans as (select uid, n, d, sum(fresh) over (partition by uid, n order by d) as span from lines),
asked as (select uid, n, span, label, size, every, bit_or(bits) as bits from votes join spans using (uid, n, d) group by all),
cover as (select uid, n, span, count(distinct x) as c from (select uid, n, span, unnest(range(j, j + {k})) as x from votes join spans using (uid, n, d) where covers) group by all),
shares as (select uid, label, every, bits, coalesce(c, 0) / size::double as share from asked left join cover using (uid, n, span)),
found as (select uid, max(share) as share from shares group by uid),
named as (select uid, label from places union select uid, label from shares where share >= {license.COVER} and bits = every),
every as (select uid, array_to_string(list_sort(list(label)), ',') as labels from named group by uid)
select w.doc_id, len(ws)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word, coalesce(b.labels, '') as base_labels,
  coalesce(e.labels, '') as labels, case when b.n > 0 then 1.0::double else coalesce(f.share, 0.0::double) end as score
from w left join base b using (uid) left join every e using (uid) left join found f using (uid)
"""


_DECONTAM = f"""
with d as (select row_number() over () as uid, doc_id, {_WORDS} as ws from documents),
b as (select item_id, ws, len(ws) as w, least({decontam.K}, len(ws)) as n from (select item_id, {_WORDS} as ws from benchmark) where item_id is not null and len(ws) > 0),
ig as (select item_id, n, w, gram, count(*) as c from (select item_id, n, w, array_to_string(ws[j:j + n - 1], ' ') as gram from (select *, unnest(range(1, w - n + 2)) as j from b)) group by all),
dg as (select uid, n, p, array_to_string(ws[p:p + n - 1], ' ') as gram from (select uid, ws, n, unnest(range(1, len(ws) - n + 2)) as p from d cross join (select distinct n from b))),
hits as (select uid, item_id, n, w, p from dg join ig using (n, gram)),
cand as (select uid, item_id, n, w from hits group by all having count(*) >= {decontam.SIMILARITY}::double * (w - n + 1)),
starts as (
  select distinct uid, item_id, n, w, s, w - n + 1 as run from (select h.*, len(ws) as size, unnest(range(p - (h.w - h.n), p + 1)) as s from hits h semi join cand using (uid, item_id) join d using (uid))
  where size >= w and s >= 1 and s + w - 1 <= size
  union select uid, item_id, n, w, 1, len(ws) - n + 1 from cand join d using (uid) where len(ws) < w
), wg as (
  select s.uid, s.item_id, s.n, s.w, s.s, s.run, g.gram, count(*) as c from starts s join dg g on g.uid = s.uid and g.n = s.n and g.p between s.s and s.s + s.run - 1 group by all
), sims as (
  select uid, item_id, s, shared / (run + (w - n + 1) - shared)::double as x from (
    select wg.uid, wg.item_id, wg.s, wg.run, wg.w, wg.n, sum(least(wg.c, ig.c)) as shared from wg join ig on ig.item_id = wg.item_id and ig.gram = wg.gram group by all)
), best as (select *, row_number() over (partition by uid, item_id order by x desc, s) as rn from sims where x >= {decontam.SIMILARITY}::double)
select d.doc_id, item_id, x as similarity, (s - 1)::bigint as first_word from best join d using (uid) where rn = 1
"""


def _chat_sql() -> str:
    options = ", ".join(f"({r}, {s}, {k}, {c}, {n}, '{a}', '{','.join(fill)}')" for r in range(4) for s in range(4) for k, (c, n, a, fill) in enumerate(chat.OPTIONS[r][s]))
    finish = ", ".join(f"({s}, {int(chat.FINISH[s])}, '{','.join(chat.ENDING[s])}')" for s in range(4))
    close = "'<|im_end|>' || chr(10)"
    empty = lambda roles: f"case when {roles} = '' then '' else array_to_string(list_transform(string_split({roles}, ','), lambda r: '<|im_start|>' || r || chr(10) || {close}), '') end"
    return f"""
with recursive o as (select * from (values {options}) v(code, state, ord, cost, nxt, action, fill)),
z as (select * from (values {finish}) v(state, cost, ending)),
t as (
  select dense_rank() over (order by conv_id) as cid, conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '< |im_') as body,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, md5(text) nulls first) as i, count(*) over (partition by conv_id) as n,
    case lower(trim(coalesce(role, ''))) when 'system' then 0 when 'user' then 1 when 'assistant' then 2 else 3 end as code
  from conversations
), g(cid, i, state, v) as (
  select distinct cid, n + 1, z.state, z.cost::bigint from t cross join z
  union all
  select g.cid, g.i - 1, o.state, min(o.cost + g.v)::bigint from g join t on t.cid = g.cid and t.i = g.i - 1 join o on o.code = t.code and o.nxt = g.state group by g.cid, g.i, o.state
), ch as (
  select t.cid, t.i, o.*, row_number() over (partition by t.cid, t.i, o.state order by o.cost + g.v, o.ord) as rn
  from t join o on o.code = t.code join g on g.cid = t.cid and g.i = t.i + 1 and g.state = o.nxt
), f(cid, i, state) as (
  select distinct cid, 1::bigint, 0 from t
  union all
  select f.cid, f.i + 1, ch.nxt from f join ch on ch.cid = f.cid and ch.i = f.i and ch.state = f.state and ch.rn = 1
), x as (
  select t.*, f.state, c.nxt, c.action, c.fill, c.cost, z.ending, z.cost as last_cost
  from t join f using (cid, i) join ch c on c.cid = t.cid and c.i = t.i and c.state = f.state and c.rn = 1 join z on z.state = c.nxt
)
select conv_id, turn, role, case nxt when 1 then 'system' when 2 then 'user' else 'assistant' end as new_role, action,
  case when i = n then array_to_string(list_filter([fill, ending], lambda y: y <> ''), ',') else fill end as inserted,
  (cost + case when i = n then last_cost else 0 end)::bigint as cost,
  case when action = 'merge' then chr(10) || body
    else case when state <> 0 then {close} else '' end || {empty("fill")} || '<|im_start|>' || case nxt when 1 then 'system' when 2 then 'user' else 'assistant' end || chr(10) || body end
    || case when i = n then {close} || {empty("ending")} else '' end as rendered
from x
"""


def _url_sql() -> str:
    """All token combinations of the labelled URLs instead of a tree of frequent ones."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urlfilter.RULES)
    return rf"""
with u as (
  select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, string_split(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)), '.') as ls, row_number() over () as uid
  from pages
), k as (
  select uid, page_id, case when not regexp_matches(coalesce(url, ''), '(?s)^.*?://') then [] else list_sort(list_distinct(
    ['s:' || lower(regexp_extract(url, '(?s)^(.*?)://', 1)), 't:' || ls[len(ls)], 'd:' || array_to_string(ls[greatest(len(ls) - 1, 1):len(ls)], '.')]
    || list_transform(ls[1:len(ls) - 2], lambda x: 'h:' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
    || list_transform(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || string_split(x, '=')[1]))) end as tokens from u
), l as (select doc_id as page_id, coalesce(max(quality = 0 or toxic = 1), false) as bad from labels where doc_id is not null group by doc_id),
b as (select tokens, bad::int as bad from k join l using (page_id)),
c as (select bad, list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1) as combo from (select *, unnest(range(1, (1 << len(tokens))::bigint)) as mask from b)),
m as (select combo, sum(bad)::double as hits, count(*)::double as n from c group by combo),
e as (select *, hits / n as p, {urlfilter.Z}::double * {urlfilter.Z}::double as zz from m),
r as (
  select combo from e where hits >= greatest({urlfilter.LEAST}, ceil({urlfilter.SUPPORT}::double * (select count(*) from b))) and p >= {urlfilter.CONFIDENCE}::double
    and (p + zz / (2 * n) - {urlfilter.Z}::double * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n) >= {urlfilter.LIFT}::double * (select avg(bad) from b)
), hit as (select uid, bool_or(list_has_all(tokens, combo)) as blocked from k cross join r group by uid),
f as (
  select uid, h || p as rule, v, row_number() over (partition by uid order by length(h || p) desc) as rn from u join (values {rules}) w(h, p, v)
  on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select u.page_id, host, path, rule, coalesce(v, case when blocked then 'block' else 'allow' end) as verdict
from u left join (select * from f where rn = 1) f using (uid) left join hit using (uid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _url_sql(), "op4_chat_format": _chat_sql(), "op5_license_scan": _license_sql(), "op7_decontamination": _DECONTAM, "op2_exact_topk": _TOPK, "op6_warc": _WARC, "op9_minhash_dedup": _NEAR}
