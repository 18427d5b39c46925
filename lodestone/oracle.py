"""DuckDB SQL over the same tables, built from named parts.

``sql(body)`` puts a WITH clause before a query that holds the parts it names, and the
parts these name. The parts are written from the definitions and not from the plans.
"""

from __future__ import annotations

import re

#: The characters that count as white space (Unicode White_Space).
_CODES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WS = "(" + "||".join(f"chr({c})" for c in _CODES) + ")"
ENT = "'[A-Z][a-z]{4,}'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clip(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then substr({x}, 1, {n}) || '...' else {x} end"


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''))"


PARTS = {
    "docs": "select doc_id, source as qa_id, coalesce(text, '') as text from documents",
    "ques": "select item_id as qid, coalesce(text, '') as text from benchmark",
    "paras": "select doc_id, qa_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from docs",
    "chunks": f"select 'C::' || qa_id || '::' || doc_id || '::s' || ord as chunk_id, doc_id, qa_id, ord, {strip('raw')} as text from paras where {strip('raw')} <> ''",
    # samples
    "entries": f"""select doc_id::varchar as qa_id, string_split(full_text, chr(10))[1] as question, pos, {strip("string_split(raw, ' ')[1]")} as title, regexp_split_to_array(raw, '[.|!?] ') as sents
        from (select doc_id, full_text, unnest(string_split(full_text, chr(10))) as raw, generate_subscripts(string_split(full_text, chr(10)), 1) - 1 as pos from (select doc_id, coalesce(text, '') as full_text from documents))""",
    "titled": "select *, row_number() over (partition by qa_id, title order by pos) as rn from entries where title <> ''",
    "kept_entries": "select * from titled where rn = 1",
    "supports": "select distinct qa_id, title from entries where pos < 2",
    "sents": f"""select 'C::' || qa_id || '::' || title || '::s' || i as id, {strip('s')} as text, title, i as sent_idx, qa_id, question, pos
        from (select *, unnest(sents) as s, generate_subscripts(sents, 1) - 1 as i from kept_entries) where {strip('s')} <> ''""",
    # retrieval
    "posted": f"select doc_id, unnest({tokens('text')}) as term from docs",
    "asked": f"select qid, unnest({tokens('text')}) as term from ques",
    "sparse": "select qid, doc_id, count(*)::double as score from posted join asked using (term) group by all",
    "sparse100": "select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rk from sparse) where rk <= 100",
    "vecs": "select vec_id as doc_id, embedding::double[] as vec, case when n = 0 then 1e-10 else n end as norm from (select *, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings where embedding is not null)",
    "qvecs": "select qid, vec, norm from ques join vecs on qid = doc_id",
    "dense": "select q.qid, v.doc_id, round(list_inner_product(q.vec, v.vec) / (q.norm * v.norm), 6) + 0.0 as score from qvecs q cross join vecs v",
    "dense100": "select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rk from dense) where rk <= 100",
    "rrf": "select qid, doc_id, sum(1.0::double / (60 + rk)) as score from (select qid, doc_id, rk from dense100 union all select qid, doc_id, rk from sparse100) group by all",
    "fused": "select qid, doc_id, round(score, 9) as score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rk from rrf",
    "intents": r"""select qid, text, case when regexp_matches(lower(text), '(^|[^a-z])(that|which|whose)([^a-z]|$)') then 'Sequential' else 'Parallel' end as topology,
        case when regexp_matches(lower(text), '(^|[^a-z])(who|whom|whose|he|she|her|his)([^a-z]|$)') then 'HUM' when regexp_matches(lower(text), '(^|[^a-z])(where|in|at|from|near)([^a-z]|$)') then 'LOC' else 'OTHER' end as semantic from ques""",
    "pass1": "select f.* from fused f join intents i using (qid) where topology = 'Sequential' and rk <= 30",
    "follow": f"""select qid, substr(case when t = '' then coalesce(more, '') when coalesce(more, '') = '' then t else t || ' ' || more end, 1, 600) as text
        from (select qid, {strip('text')} as t from intents where topology = 'Sequential')
        left join (select p.qid, string_agg(c.text, ' ' order by p.rk, c.ord) as more from pass1 p join chunks c using (doc_id) where p.rk <= 2 and c.ord < 3 group by p.qid) using (qid)""",
    "asked2": f"select qid, unnest({tokens('text')}) as term from follow",
    "sparse2": "select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rk from (select qid, doc_id, count(*)::double as score from posted join asked2 using (term) group by all)) where rk <= 100",
    "rrf2": "select qid, doc_id, sum(1.0::double / (60 + rk)) as score from (select qid, doc_id, rk from dense100 join (select qid from follow) using (qid) union all select qid, doc_id, rk from sparse2) group by all",
    "pass2": "select * from (select qid, doc_id, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rk from rrf2) where rk <= 60",
    "merged": """select qid, doc_id, pass, rk, row_number() over (partition by qid order by pass, rk) as pos from (
        select *, row_number() over (partition by qid, doc_id order by pass, rk) as rn from (select qid, doc_id, 1::bigint as pass, rk from pass1 union all select qid, doc_id, 2::bigint as pass, rk from pass2)) where rn = 1""",
    # graph
    "ments": f"""select chunk_id, doc_id, ord, chunk_text, entity, row_number() over (partition by chunk_id order by i) - 1 as pos from (select chunk_id, doc_id, ord, chunk_text, entity, min(i) as i
        from (select chunk_id, doc_id, ord, text as chunk_text, unnest(l) as entity, generate_subscripts(l, 1) as i from (select *, regexp_extract_all(text, {ENT}) as l from chunks)) group by all)""",
    "facts": f"""select chunk_id || '_fact_' || idx as fact_id, chunk_id, doc_id, ord, idx, {strip('s')} as text
        from (select *, unnest(l) as s, generate_subscripts(l, 1) - 1 as idx from (select chunk_id, doc_id, ord, regexp_split_to_array(text, '[.|!?] ') as l from chunks)) where {strip('s')} <> ''""",
    "bound": "select f.*, m.entity, m.pos from facts f join ments m on f.chunk_id = m.chunk_id and contains(lower(f.text), lower(m.entity))",
    "ends": f"""select fact_id, unnest(list_distinct([l[1], l[len(l)]])) as entity from (select fact_id, regexp_extract_all(text, {ENT}) as l from facts) where len(l) > 0""",
    "firsts": "select entity, text, row_number() over (partition by entity order by a, text) as rn from (select entity, text, min({'d': doc_id, 'o': ord, 'i': idx}) as a from bound group by all)",
    "ptexts": "select entity, 'prop::' || substr(sha1(prop_text), 1, 10) as prop_id, prop_text from (select entity, string_agg(text, ' ' order by rn) as prop_text from firsts where rn <= 10 group by entity)",
    "plinks": "select t.prop_id, b.entity, b.fact_id, b.chunk_id from bound b join ptexts t using (entity)",
    "ppairs": "select distinct l.prop_id, b.entity from (select distinct prop_id, fact_id from plinks) l join bound b using (fact_id)",
    "canon": rf"select *, regexp_replace(lower({strip('entity')}), '\s+', ' ', 'g') as canonical from ments",
    "ents": "select 'ent::' || canonical as id, canonical, f.e as text, f.c as context from (select canonical, arg_min({'e': entity, 'c': chunk_text}, {'d': doc_id, 'o': ord, 'p': pos}) as f from canon group by canonical)",
    "cache": "select canonical, case when length(canonical) < 7 then 'PERSON' when length(canonical) < 9 then 'LOCATION' when length(canonical) < 11 then 'OTHER' else 'UNKNOWN' end as label from ents where regexp_matches(canonical, '^[aeiou]')",
    "typed": """select e.id, e.canonical, e.text, coalesce(c.label, case
          when contains(x, 'in ' || e.canonical) or contains(x, 'at ' || e.canonical) or contains(x, 'from ' || e.canonical) then 'LOCATION'
          when contains(x, e.canonical || ' is ') or contains(x, e.canonical || ' was ') or contains(x, e.canonical || ' and ') then 'PERSON' else 'OTHER' end) as label
        from (select *, lower(substr(context, 1, 220)) as x from ents) e left join (select * from cache where label in ('PERSON', 'LOCATION', 'OTHER')) c using (canonical)""",
    "tnodes": "select distinct 'type::' || label as id, label as text from typed",
    "sup_edges": "select distinct prop_id as src, chunk_id as dst, 'SUPPORTED_BY' as edge_type from plinks",
    "ep": "select distinct prop_id, 'ent::' || lower(entity) as ent from ppairs",
    "ep_edges": "select prop_id as src, ent as dst, 'ASSERTS' as edge_type from ep union all select ent, prop_id, 'INVOLVED_IN' from ep",
    "isa_edges": "select id as src, 'type::' || label as dst, 'IS_A' as edge_type from typed",
    "edges": "select * from sup_edges union all select * from ep_edges union all select * from isa_edges",
    "nodes": """select chunk_id as id, 'chunk' as node_type, text from chunks union all select prop_id, 'proposition', min(prop_text) from ptexts group by prop_id
        union all select id, 'entity', text from typed union all select id, 'type', text from tnodes""",
    "skel": "select prop_id as u, ent as v from ep union all select ent, prop_id from ep",
    "deg": "select u as id, count(*) as degree from skel group by u",
    "prior": "select id, round(case when hi - lo < 1e-12 then 0.0::double else (degree - lo) / (hi - lo) end, 9) as s_struct from (select *, min(degree) over ()::double as lo, max(degree) over ()::double as hi from deg)",
    # query path
    "seeds": "select distinct s.qid, c.chunk_id as id from (select * from sparse100 where rk <= 5) s join chunks c using (doc_id)",
    "first": "select distinct s.qid, e.src as id from seeds s join sup_edges e on e.dst = s.id",
    "ents1": "select distinct f.qid, e.ent as id from first f join ep e on e.prop_id = f.id",
    "reached": "select distinct qid, id from (select e.qid, p.prop_id as id from ents1 e join ep p on p.ent = e.id union all select qid, id from first)",
    "pt": f"select prop_id as id, {tokens('substr(min(prop_text), 1, 420)')} as t from ptexts group by prop_id",
    "qt": f"select qid, {tokens('text')} as q from ques",
    "sem": "select r.qid, r.id, case when len(q) > 0 then round(len(list_intersect(q, t)) / len(q)::double, 6) else 0.0::double end as s_sem from reached r join pt using (id) join qt using (qid)",
    "scored": "select qid, id, s_struct, s_sem, round(s_struct + 0.5::double * coalesce(s_sem, 0), 9) as final from reached join prior using (id) left join sem using (qid, id)",
    "anch": "select * from (select *, row_number() over (partition by qid order by final desc, id) as rk from scored) where rk <= 8",
    "cand": "select a.qid, a.id as anchor, e.ent as entity from anch a join ep e on e.prop_id = a.id",
    "lineage": """select c.* from cand c join intents i using (qid) left join typed t on t.id = c.entity
        where semantic = 'OTHER' or (semantic = 'HUM' and label = 'PERSON') or (semantic = 'LOC' and label = 'LOCATION')""",
    "kept": "select * from (select qid, id, s_struct, round(s_struct, 9) as final, row_number() over (partition by qid order by round(s_struct, 9) desc, id) as rk from (select distinct qid, entity as id from lineage) join prior using (id)) where rk <= 6",
    "expd": "select l.qid, e.prop_id as prop, l.anchor, l.entity from lineage l join kept k on k.qid = l.qid and k.id = l.entity join ep e on e.ent = l.entity",
    "fresh": "select x.* from expd x where not exists (select 1 from anch a where a.qid = x.qid and a.id = x.prop)",
    "grown": """select m.qid, m.id, round(coalesce(s.final, 0.3::double * coalesce(p.s_struct, 0) + (1 - 0.3::double) * (0.8::double * m.lead_score)), 9) as final
        from (select f.qid, f.prop as id, max(a.final) as lead_score from fresh f join anch a on a.qid = f.qid and a.id = f.anchor group by all) m
        left join scored s on s.qid = m.qid and s.id = m.id left join prior p on p.id = m.id""",
    "props": """select * from (select *, row_number() over (partition by qid order by final desc, id) as rk from (
        select qid, id, max(final) as final from (select qid, id, final from anch union all select qid, id, final from grown) group by all)) where rk <= 18""",
    "scores": "select qid, id, max(final) as final from (select qid, id, final from scored union all select qid, id, final from grown) group by all",
    "psup": "select p.qid, p.id as prop, e.dst as chunk, p.final as p_final from props p join sup_edges e on e.src = p.id",
    "cscore": "select d.qid, d.chunk, max(coalesce(s.final, 0)) as c_score from (select distinct qid, chunk from psup) d join sup_edges e on e.dst = d.chunk left join scores s on s.qid = d.qid and s.id = e.src group by all",
    "pchunks": "select * from (select p.*, c.c_score, row_number() over (partition by p.qid, p.prop order by c.c_score desc, p.chunk) as rk from psup p join cscore c using (qid, chunk)) where rk <= 3",
    "b_chunk": "select qid, chunk as id, max(p_final) as score from pchunks group by all",
    "b_ent": "select p.qid, e.ent as id, max(p.final) as score from props p join ep e on e.prop_id = p.id group by all",
    "b_type": "select b.qid, e.dst as id, max(b.score) as score from b_ent b join isa_edges e on e.src = b.id group by all",
    "buckets": """select b.qid, b.node_type, b.id, n.text, b.score from (select qid, id, final as score, 'proposition' as node_type from props union all select qid, id, score, 'chunk' from b_chunk
        union all select qid, id, score, 'entity' from b_ent union all select qid, id, score, 'type' from b_type) b join nodes n on n.id = b.id and n.node_type = b.node_type""",
    "normed": f"""select qid, node_type, id, score, case node_type when 'proposition' then {clip(strip('text'), 520)} when 'chunk' then {clip(strip('text'), 650)}
        when 'entity' then {clip(strip('text'), 120)} else {clip(strip('text'), 40)} end as text from buckets where id <> ''""",
    "chosen": """select * from (select *, row_number() over (partition by qid, node_type order by score desc, id) as rk from normed)
        where rk <= case node_type when 'proposition' then 3 when 'entity' then 5 when 'chunk' then 5 else 2 end""",
    "headers": "select qid, string_agg(upper(text), ', ' order by rk) as header from chosen where node_type = 'type' group by qid",
    # the benchmark's own small graph
    "b_chunks": f"select 'C::' || item_id || '::s' || ord as chunk_id, item_id as doc_id, ord, {strip('raw')} as text from (select item_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from (select item_id, coalesce(text, '') as text from benchmark)) where {strip('raw')} <> ''",
    "b_ments": f"select distinct chunk_id, entity from (select chunk_id, unnest(regexp_extract_all(text, {ENT})) as entity from b_chunks)",
    "b_facts": f"select chunk_id || '_fact_' || idx as fact_id, chunk_id, doc_id, ord, idx, {strip('s')} as text from (select *, unnest(l) as s, generate_subscripts(l, 1) - 1 as idx from (select chunk_id, doc_id, ord, regexp_split_to_array(text, '[.|!?] ') as l from b_chunks)) where {strip('s')} <> ''",
    "b_bound": "select f.*, m.entity from b_facts f join b_ments m on f.chunk_id = m.chunk_id and contains(lower(f.text), lower(m.entity))",
    "b_firsts": "select entity, text, row_number() over (partition by entity order by a, text) as rn from (select entity, text, min({'d': doc_id, 'o': ord, 'i': idx}) as a from b_bound group by all)",
    "b_texts": "select entity, 'prop::' || substr(sha1(string_agg(text, ' ' order by rn)), 1, 10) as prop_id from b_firsts where rn <= 10 group by entity",
    "b_ep": "select distinct t.prop_id, 'ent::' || lower(c.entity) as ent from b_bound b join b_texts t using (entity) join b_bound c using (fact_id)",
    "b_skel": "select prop_id as u, ent as v from b_ep union all select ent, prop_id from b_ep",
}


def _needs(body: str, parts: dict[str, str], out: list[str]) -> None:
    pattern = re.compile(r"(?:from|join)\s+\(*\s*(" + "|".join(sorted(parts, key=len, reverse=True)) + r")\b", re.IGNORECASE)
    for name in pattern.findall(body):
        if name not in out:
            _needs(parts[name], parts, out)
            if name not in out:
                out.append(name)


def sql(body: str, **own: str) -> str:
    """The query with the parts it reads before it; ``own`` are parts of this query only."""
    parts = PARTS | own
    out: list[str] = []
    _needs(body, parts, out)
    return ("with " + ",\n".join(f"{n} as materialized ({parts[n]})" for n in out) + "\n" if out else "") + body
