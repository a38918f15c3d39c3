"""Queries over web pages: URL filters and HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affectlake.llm import html_extract, urls
from affectlake.llm.common import table
from affectlake.llm.registry import query


@query("op1_url_filter", r"""
    with u as (
        select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
    ), p as (
        select page_id,
               coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                  'abcdefghijklmnopqrstuvwxyz'), '') as host,
               coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
        from u
    ), r as (
        select *, case
                 when ends_with('.' || host, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
                 when ends_with('.' || host, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
                 when ends_with('.' || host, '.com') and starts_with(path, '/fr/') then 'com/fr/'
                 when ends_with('.' || host, '.com') and starts_with(path, '/de/') then 'com/de/'
                 when ends_with('.' || host, '.org') and starts_with(path, '/') then 'org/' end as rule,
               list_transform(string_split(path, '/')[2:], lambda s: regexp_replace(
                   regexp_replace(s, '[0-9a-f]{16,}', '{h}', 'g'), '[0-9]+', '{n}', 'g')) as formed
        from p
    ), l as (
        select *, case when rule in ('org/', 'com/fr/') then 1 when rule is not null then 0 end as label from r
    ), s as (
        select host, formed, count(*) as n, coalesce(sum(label), 0)::bigint as allowed, count(label) as labelled
        from l group by host, formed
    ), w as (
        select host, depth from (
            select host, depth, value, sum(n) as n from (
                select host, n, unnest(formed) as value, unnest(range(1, len(formed) + 1)) as depth from s)
            group by host, depth, value)
        group by host, depth having count(*) > 20 and count(*) > 0.2 * sum(n)
    ), g as (
        select host, coalesce(list(depth), []) as wild from w group by host
    ), t as (
        select s.*, list_transform(formed, lambda v, i: case when list_contains(coalesce(wild, []), i)
                                   then '{*}' else v end) as segments
        from s left join g using (host)
    ), x as (
        select host, formed, segments, allowed, labelled, unnest(range(0, len(segments) + 1)) as depth from t
    ), k as (
        select host, depth, segments[1:depth] as prefix, sum(allowed) as allowed, sum(labelled) as labelled
        from x group by all
    ), o as (
        select sum(allowed) as a, sum(labelled) as n,
               case when sum(labelled) > 0 then sum(allowed)::double / sum(labelled)::double else 0.5 end as overall from s
    ), b as (
        select c.*, case when c.depth = 0 then o.a else q.allowed end::double
                    / nullif(case when c.depth = 0 then o.n else q.labelled end, 0)::double as rate
        from k c cross join o left join k q
          on c.host = q.host and c.depth = q.depth + 1 and c.prefix[1:c.depth - 1] = q.prefix
    ), e as (
        select host, depth, prefix, (allowed + 4.0::double * overall) / (labelled + 4.0::double) as purity
        from b, o
        where (allowed - labelled * rate) * (allowed - labelled * rate) > 3.84::double * labelled * rate * (1 - rate)
    ), d as (
        select x.host, x.formed, arg_max(e.purity, e.depth) as purity
        from x join e on x.host = e.host and x.depth = e.depth and x.segments[1:x.depth] = e.prefix
        group by x.host, x.formed
    )
    select l.page_id, l.host, l.path, l.rule,
           case when l.label = 1 then 'allow' when l.label = 0 then 'block'
                when coalesce(d.purity, o.overall) < 0.5 then 'block' else 'allow' end as verdict,
           l.host || case when len(t.segments) >= 0 then '/' || array_to_string(t.segments, '/') end as template,
           coalesce(d.purity, o.overall) as purity
    from l cross join o
    join t on l.host = t.host and l.formed = t.formed
    left join d on l.host = d.host and l.formed = d.formed
    """)
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op7_main_text")
def main_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
