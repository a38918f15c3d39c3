"""Queries that link similar rows: the n-gram join and the embedding graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affectlake.llm import embedding_dedup, ngram_join
from affectlake.llm.common import table
from affectlake.llm.registry import query


@query("op10_ngram_join", r"""
    with recursive d as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
        from documents
    ), s as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as g
        from d
    ), u as (
        select g, min(doc_id) as rep from (select doc_id, list_sort(g) as g from s where len(g) > 0) group by g
    ), x as (
        select rep, len(g) as n, unnest(g) as t from u
    ), p as (
        select a.rep as a, b.rep as b from x a join x b on a.t = b.t and a.rep < b.rep
        and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90
        group by a.rep, b.rep, a.n, b.n having count(*) * 100 >= 90 * (a.n + b.n - count(*))
    ), e as (
        select a, b from p union all select b, a from p
    ), r(a, b) as (
        select rep, rep from u union select r.a, e.b from r join e on r.b = e.a
    ), c as (
        select a as rep, min(b) as component_id from r group by a
    )
    select s.doc_id, len(s.g)::bigint as n_shingles, coalesce(c.component_id, s.doc_id) as component_id
    from s left join u on list_sort(s.g) = u.g left join c on u.rep = c.rep
    """)
def ngram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup")
def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(table(spark, sf_dir, "embeddings"))
