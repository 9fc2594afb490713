"""The query of the filter audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.llm import filter_audit
from datasonde.llm.registry import query, table

AUDIT_SQL = r"""
with texts as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id
), fails as (
  select t.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
         case when len(w) < 200 then 'A' else '' end
         || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
         || case when 100 * len(regexp_extract_all(body, '[A-Z]')) > 3 * length(body) then 'C' else '' end
         || case when regexp_matches(body, '[#$%&*|]') then 'D' else '' end
         || case when t.doc_id > min(t.doc_id) over (partition by body) then 'E' else '' end as failed
  from texts t left join marks m using (doc_id)
), cells as (
  select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from fails group by part, failed
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
  select filter_order, unnest(generate_series(1, 5)) as step from orders
), judged as (
  select part, filter_order, step, n, good, toxic, failed, filter_order[step] as f,
         contains(failed, filter_order[step]) as now,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' and contains(failed, x))) > 0 as before
  from cells, steps
), counted as (
  select part, filter_order, step, f,
         cast(sum(case when not now and not before then n else 0 end) as bigint) as kept,
         cast(sum(case when now and not before then n else 0 end) as bigint) as removed,
         cast(sum(case when now and before then n else 0 end) as bigint) as redundant,
         cast(sum(case when failed = f then n else 0 end) as bigint) as unique_fails,
         cast(sum(case when now and not before then good else 0 end) as bigint) as good_lost,
         cast(sum(case when now and not before then toxic else 0 end) as bigint) as toxic_lost
  from judged group by part, filter_order, step, f
)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from counted
"""


@query("op11_filter_audit", AUDIT_SQL)
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return filter_audit.filter_audit(docs, labels)
