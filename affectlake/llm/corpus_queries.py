"""Queries of the operators that count over all texts: collocations, repeated lines, spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affectlake.llm import collocations, lines, spelling
from affectlake.llm.common import table
from affectlake.llm.registry import query

FIRST = 2_000


@query("op11_collocations", r"""
    with p as (
        select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
        from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
    ), g as (
        select lang, k, w[s : s + k - 1] as ws, count(*) as f
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s
              from p, (select unnest([1, 2, 3]) as k) where len(w) >= k) group by all
    ), t as (
        select lang, sum(f)::bigint as n from g where k = 1 group by lang
    ), c as (
        select * from g where k > 1 and f >= 10
    ), x as (
        select c.lang, c.ws, c.f as a, u.cut, l.f as l, r.f as r,
               (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) as score
        from c, lateral (select unnest(range(1, c.k)) as cut) u
        join g l on l.lang = c.lang and l.ws = c.ws[1 : u.cut]
        join g r on r.lang = c.lang and r.ws = c.ws[u.cut + 1 : c.k]
    ), b as (
        select lang, ws, a, l, r, score from x qualify row_number() over (partition by lang, ws order by score, cut) = 1
    ), o as (
        select lang, inner_ws as ws, max(f) as f
        from (select lang, f, unnest([ws[1:2], ws[2:3]]) as inner_ws from c where k = 3) group by all
    ), z as (
        select b.*, array_to_string(b.ws, ' ') as phrase
        from b left join o on o.lang = b.lang and o.ws = b.ws where o.f is null or 100 * o.f < 50 * b.a
    ), y as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z
    )
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
    from y join t using (lang) where rank <= 2000
    """)
def collocation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return collocations.ranked(found, FIRST).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_line_dedup", r"""
    with d as (
        select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
    ), l as (
        select r, doc_id, i, ls[i] as line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
        from (select *, unnest(range(1, len(ls) + 1)) as i from d)
    ), k as (
        select key, max(doc_id) as holder from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3
    ), m as (
        select l.r, l.i, l.line, k.key is not null and l.doc_id <> k.holder as dropped from l left join k using (key)
    ), a as (
        select r, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
               coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '') as kept
        from m group by r
    )
    select d.doc_id, a.n_lines::bigint as n_lines, a.n_dropped::bigint as n_dropped, sha256(a.kept) as kept_sha256
    from d join a using (r)
    """)
def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_spelling_variants")
def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.group(words).select("word", "form", "root", "n", "n_near", "form_n")
