"""Queries of the operators that SQL can express, next to that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datasonde.llm.line_dedup import without_repeats
from datasonde.llm.mixing import mixing_plan
from datasonde.llm.registry import query, table
from datasonde.llm.url_filter import judge_urls

# Lines of three at a time, long ones in pieces: later occurrences cover positions, and what is covered goes.
LINE_SQL = r"""
with raw as (
  select doc_id, generate_subscripts(lines, 1) as i, unnest(lines) as line
  from (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null)
), cut as (
  select doc_id, i, case
    when len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= 16 then [line]
    else regexp_extract_all(line, '[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){8,15}?[^\x20\x09-\x0D]*[.!?,;:egklpu\x{0430}\x{043A}\x{043B}\x{043F}](?:[\x20\x09-\x0D]+|\z)|[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+|\z)){1,16}')
    end as pieces
  from raw
), units as (
  select doc_id, i, generate_subscripts(pieces, 1) as j, unnest(pieces) as piece from cut
), solid as (
  select doc_id, i, j, i * 10000000 + j as place, trim(piece, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) as body from units
  where trim(piece, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) <> ''
), numbered as (
  select *, row_number() over w as k, count(*) over (partition by doc_id) as n,
         lead(body, 1) over w as second, lead(body, 2) over w as third
  from solid window w as (partition by doc_id order by place)
), windows as (
  select doc_id, k, place, least(n, 3) as width, body, second, third from numbered where k <= greatest(n - 2, 1)
), ranked as (
  select *, row_number() over (partition by width, body, second, third order by doc_id, place) as seen from windows
), covered as (
  select distinct doc_id, unnest(generate_series(k, k + width - 1)) as k from ranked where seen > 1
), marked as (
  select u.doc_id, u.i, u.j, u.piece, n.k, c.k is not null as gone
  from units u left join numbered n on n.doc_id = u.doc_id and n.i = u.i and n.j = u.j
  left join covered c on c.doc_id = n.doc_id and c.k = n.k
), placed as (
  -- Blank lines between covered pieces of one window go with them.
  select *, max(k) over (partition by doc_id order by i, j) as before from marked
), joined_windows as (
  select distinct doc_id, unnest(generate_series(k, k + width - 2)) as k from ranked where seen > 1
), kept as (
  select p.doc_id, p.i, string_agg(p.piece, '' order by p.j) as line from placed p
  where not p.gone and not (p.k is null and exists (select 1 from joined_windows w where w.doc_id = p.doc_id and w.k = p.before))
  group by p.doc_id, p.i
), left_over as (
  select doc_id, string_agg(line, chr(10) order by i) as text from kept group by doc_id
), counts as (
  select doc_id, count(*) as n_lines, sum(all_gone) as n_removed from (
    select doc_id, i, case when bool_and(gone) then 1 else 0 end as all_gone from marked where k is not null group by doc_id, i
  ) group by doc_id
)
select d.doc_id, case when d.text is null then null else coalesce(l.text, '') end as text,
       cast(coalesce(c.n_lines, 0) as bigint) as n_lines, cast(coalesce(c.n_removed, 0) as bigint) as n_removed
from documents d left join left_over l using (doc_id) left join counts c using (doc_id)
"""


@query("op2_line_dedup", LINE_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("row.doc_id"),
        F.col("new_text").alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
    )


URL_SQL = r"""
with parsed as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parsed
), ruled as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule,
    list_transform(string_split(path, '/'), lambda s: case when regexp_matches(s, '[0-9]')
      then '*' || regexp_extract(s, '[0-9].*?(\.[A-Za-z]+)?$', 1) else s end) as shape
  from split
), labels_ as (
  select *, case when rule is null then null when rule in ('com/', 'www.example.com/en/') then 0 else 1 end as bad from ruled
), leaves as (
  select host, shape, count(bad) as labelled, coalesce(sum(bad), 0) as blocked from labels_ group by host, shape
), depths as (
  select host, shape, labelled, blocked, generate_subscripts(shape, 1) as depth, unnest(shape) as segment from leaves
), segments as (
  select *, array_to_string(shape[1:depth - 1], '/') || case when depth = 1 then '' else '/' end as parent from depths
), branches as (
  select host, parent, segment, sum(labelled) as labelled, sum(blocked) as blocked,
         segment <> '' and not starts_with(segment, '*') as literal
  from segments group by host, parent, segment
), classed as (
  select *, sum(case when literal then 1 else 0 end) over (partition by host, parent) as siblings,
         case when literal and labelled > 0 then blocked * 20 // labelled end as class
  from branches
), pooled as (
  select *, sum(blocked) over w / sum(labelled) over w as pool
  from classed where class is not null window w as (partition by host, parent, class)
), similar_ as (
  select host, parent, segment, count(*) over (partition by host, parent, class) as members from pooled
  where abs(blocked - labelled * pool) <= 1.96::double * sqrt(labelled * pool * (1 - pool)) + 0.5 and class not between 1 and 18
), named as (
  select k.host, k.parent, k.segment,
         case when s.members > 1 then '+' || cast(cast(k.class as bigint) as varchar)
              when k.literal and k.labelled = 0 and k.siblings > 50 then '**' else k.segment end as name
  from classed k left join similar_ s on s.host = k.host and s.parent = k.parent and s.segment = k.segment
), paths as (
  select s.host, s.shape, any_value(s.labelled) as labelled, any_value(s.blocked) as blocked, string_agg(n.name, '/' order by s.depth) as template
  from segments s join named n on n.host = s.host and n.parent = s.parent and n.segment = s.segment group by s.host, s.shape
), judged as (
  select host, template, (sum(blocked) + 5.0::double * 0.3::double) / (sum(labelled) + 5.0::double) as purity from paths group by host, template
)
select l.page_id, l.host, l.path, l.rule,
       case when l.bad = 1 then 'block' when l.bad = 0 then 'allow' when j.purity >= 0.5 then 'block' else 'allow' end as verdict,
       p.template, j.purity
from labels_ l left join paths p on p.host = l.host and p.shape = l.shape
left join judged j on j.host = p.host and j.template = p.template
"""


@query("op7_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("row.page_id", "host", "path", "rule", "verdict", "template", "purity")


MIX_SQL = r"""
with sized as (
  select doc_id, source,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 4) as bigint) as bin
  from documents
), sources as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select *, ([5.0, 2.0, 1.0]::double[])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight,
         2.0::double * source_size as cap
  from sources
), filled as (
  select *, 1.5::double * sum(source_size) over () as wanted, sum(weight) over () as weights,
         coalesce(sum(cap) over before, 0) as caps_before, coalesce(sum(weight) over before, 0) as weights_before
  from weighted
  window before as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), capped as (
  select *, cap * (weights - weights_before) <= (wanted - caps_before) * weight as is_full from filled
), leveled as (
  select *, coalesce(sum(cap) filter (where is_full) over (), 0) as caps, coalesce(sum(weight) filter (where is_full) over (), 0) as full_weight
  from capped
), targets as (
  select source, source_size, case when is_full then cap else weight * ((wanted - caps) / (weights - full_weight)) end as target from leveled
), rates as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets
), bins as (
  select source, bin, sum(size)::bigint as words from sized group by source, bin
), running as (
  select source, bin, words, sum(words) over (partition by source order by bin) as upto from bins
), cuts as (
  select r.source, max(r.bin) as cut
  from running r join rates t on t.source is not distinct from r.source
  where (2 * r.upto - r.words)::double < 2.0::double * (t.target - t.whole * t.source_size) group by r.source
)
select s.doc_id, s.size, t.source_size, t.target,
       (t.whole + case when s.bin <= coalesce(c.cut, -1) then 1 else 0 end) * s.size as taken
from sized s join rates t on t.source is not distinct from s.source left join cuts c on c.source is not distinct from s.source
"""


@query("op8_mixing", MIX_SQL)
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("row.doc_id", "size", "source_size", "target", "taken")
