"""Queries of the native operators: chat formatting and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affectlake.llm.common import table
from affectlake.llm.conversations import neighbours, preference_pairs
from affectlake.llm.mixing import mix
from affectlake.llm.registry import query


@query("op2_preference_pairs", r"""
    with t as (
        select distinct conv_id // 2 as pair_id, conv_id % 2 = 0 as is_chosen, conv_id, turn,
               coalesce(role, '') as role, coalesce(text, '') as text
        from conversations where conv_id is not null
    ), n as (
        select *, row_number() over (partition by conv_id order by turn, role, text) as pos,
               '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as said,
               4 + length(role) + 1 as head
        from t
    ), p as (
        select pair_id, max(conv_id) filter (is_chosen) as chosen_id,
               max(conv_id) filter (not is_chosen) as rejected_id,
               coalesce(max(pos) filter (is_chosen), 0) as na, coalesce(max(pos) filter (not is_chosen), 0) as nb
        from n group by pair_id
    ), d as (
        select a.pair_id, min(a.pos) as pos from n a join n b on a.pair_id = b.pair_id and a.pos = b.pos
            and a.is_chosen and not b.is_chosen
        where a.role <> b.role or a.text <> b.text group by a.pair_id
    ), s as (
        select p.*, coalesce(d.pos - 1, least(na, nb)) as n_shared from p left join d using (pair_id)
    ), r as (
        select n.*, s.n_shared,
               coalesce(sum(length(said)) over (partition by conv_id, n.pos > s.n_shared order by n.pos
                        rows between unbounded preceding and 1 preceding), 0) + head as start
        from n join s using (pair_id)
    )
    select s.pair_id, s.chosen_id, s.rejected_id, s.n_shared,
           coalesce(string_agg(said, '' order by pos) filter (is_chosen and pos <= r.n_shared), '') as prompt,
           coalesce(string_agg(said, '' order by pos) filter (is_chosen and pos > r.n_shared), '') as chosen,
           coalesce(string_agg(said, '' order by pos) filter (not is_chosen and pos > r.n_shared), '') as rejected,
           coalesce(string_agg(start || ':' || (start + length(text)), ';' order by pos)
                    filter (is_chosen and pos > r.n_shared and role = 'assistant'), '') as chosen_mask,
           coalesce(string_agg(start || ':' || (start + length(text)), ';' order by pos)
                    filter (not is_chosen and pos > r.n_shared and role = 'assistant'), '') as rejected_mask
    from s join r using (pair_id)
    group by s.pair_id, s.chosen_id, s.rejected_id, s.n_shared
    """)
def preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(neighbours(table(spark, sf_dir, "conversations")))


MIX_SQL = r"""
    with d as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
               md5('mix|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as key
        from documents
    ), s as (
        select source, sum(size)::bigint as source_size from d group by source
    ), w as (
        select *, 3 * source_size as cap, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s
    ), l as (
        select *, ((sum(source_size) over () - coalesce(sum(cap) over (
                       order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)
                  )::double / sum(weight) over (
                       order by cap / weight, source nulls last rows between current row and unbounded following)) as level
        from w
    ), f as (
        select max(level) as final from l where level * weight <= cap
    ), t as (
        select source, source_size, least(cap::double, final * weight) as target,
               floor(least(cap::double, final * weight) + 0.5)::bigint as budget
        from l, f
    ), p as (
        select d.doc_id, d.size, t.source_size, t.target, t.budget,
               coalesce(t.budget // nullif(t.source_size, 0), 0) as epochs,
               coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                        rows between unbounded preceding and 1 preceding), 0) as start
        from d join t on d.source is not distinct from t.source
    )
    select doc_id, size, source_size, target,
           (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::bigint as taken
    from p
    """


@query("op9_mix_sources", MIX_SQL)
def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
