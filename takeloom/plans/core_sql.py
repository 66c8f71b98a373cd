"""DuckDB SQL with the same results as core_queries, in plain set form."""

from __future__ import annotations

from takeloom.plans.core_queries import BREAK_MS, CALIBRATION, MEASURES

_ORPHANS = """
refs as (
  select 'stimulus_orders' as table_name, row_id, 'items' as target, lower(trim(item_id)) as k, loaded_at as moment from stimulus_orders
  union all select 'annotation_key', row_id, 'annotation_sample', lower(trim(utt_id)), loaded_at from annotation_key
  union all select 'hand_annotation', row_id, 'annotation_sample', lower(trim(utt_id)), loaded_at from hand_annotation),
targets as (
  select 'items' as target, lower(trim(item_id)) as k, loaded_at, deleted_at from items
  union all select 'annotation_sample', lower(trim(utt_id)), loaded_at, deleted_at from annotation_sample),
orphans as (
  select r.table_name, r.row_id, r.k, r.moment,
    case when count(t.k) = 0 then 'missing' when count(t.k) filter (t.loaded_at <= r.moment) = 0 then 'late' else 'deleted' end as reason
  from refs r left join targets t on t.target = r.target and t.k = r.k
  where r.k <> ''
  group by all
  having count(t.k) filter (t.loaded_at <= r.moment and (t.deleted_at is null or t.deleted_at > r.moment)) = 0)
"""


def _canonical(c: str) -> str:
    t = f"trim(cast({c} as varchar))"
    number = rf"'[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'"
    return f"case when {t} = '' or lower({t}) = 'nan' then null when regexp_full_match({t}, {number}) then cast(cast({t} as double) + 0.0 as varchar) when lower({t}) in ('true', 'false') then lower({t}) else {t} end"


def _side(name: str) -> str:
    measures = ", ".join(f"{_canonical(m)} as {m}" for m in MEASURES)
    return f"select k, {measures} from (select *, lower(trim(utt_id)) as k, row_number() over (partition by lower(trim(utt_id)) order by loaded_at desc) as rn from {name}) where rn = 1 and k <> ''"


_DIFF = f"""
a as ({_side("acoustics_v1")}), b as ({_side("acoustics_v2")}),
found as (
  select k as utt_id, '*' as measure, 'only_v1' as kind from a where k not in (select k from b)
  union all select k, '*', 'only_v2' from b where k not in (select k from a)
  {" ".join(f"union all select k, '{m}', 'differs' from a join b using (k) where a.{m} is distinct from b.{m}" for m in MEASURES)})
"""

_CLASS = r"case when count(v) = 0 then null when count(*) filter (v is not null and lower(v) not in ('true', 'false')) = 0 then 'boolean' when count(*) filter (v is not null and not regexp_full_match(v, '[+-]?[0-9]+')) = 0 then 'integer' when count(*) filter (v is not null and not regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')) = 0 then 'decimal' else 'text' end"

#: Every value of every line, fields named as in the report; records are cut at the delimiter of the header, quoted ones by a pattern.
_DRIFT = rf"""
h as (
  select file_id, series_id, written_at, replace(header, chr(65279), '') as header,
    case when len(header) - len(replace(header, ';', '')) > len(header) - len(replace(header, ',', '')) then ';' when contains(header, chr(9)) then chr(9) else ',' end as d
  from calibration_files),
named as (
  select file_id, series_id, d, lag(file_id) over (partition by series_id order by written_at, file_id) as prev,
    list_transform(string_split(header, d), lambda x: lower(trim(trim(trim(x), '"')))) as names from h),
cells as (
  select r.file_id, r.line_no, r.record, n.names,
    list_transform(regexp_extract_all(n.d || r.record, case n.d when ',' then ',("([^"]|"")*"|[^,]*)' when ';' then ';("([^"]|"")*"|[^;]*)' else '\t("([^"]|"")*"|[^\t]*)' end),
      lambda x: case when x[2] = '"' then replace(x[3:-2], '""', '"') else x[2:] end) as vals
  from (select distinct file_id, line_no, record from calibration_records) r join named n using (file_id)),
long as (
  select distinct file_id, line_no, field, case when trim(raw) = '' or lower(trim(raw)) = 'nan' then null else trim(raw) end as v
  from (select file_id, line_no, unnest(names) as field, unnest(vals) as raw from cells)),
fields as (
  select f.file_id, f.field, any_value(c.class) as class from (select file_id, unnest(names) as field from named) f
  left join (select file_id, field, {_CLASS} as class from long group by all) c using (file_id, field) group by all),
pairs as (select file_id, prev from named where prev is not null),
gone as (select p.file_id, p.prev, f.field from pairs p join fields f on f.file_id = p.prev where not exists (select 1 from fields g where g.file_id = p.file_id and g.field = f.field)),
fresh as (select p.file_id, p.prev, f.field from pairs p join fields f on f.file_id = p.file_id where not exists (select 1 from fields g where g.file_id = p.prev and g.field = f.field)),
c as (select file_id, line_no, field, {_canonical("v")} as v from long),
renamed as (
  select g.file_id, g.field, w.field as new_field
  from gone g join fresh w using (file_id, prev) join c x on x.file_id = g.prev and x.field = g.field join c y on y.file_id = w.file_id and y.field = w.field and y.line_no = x.line_no
  group by all having count(*) filter (x.v is distinct from y.v) = 0)
"""

_IS_NUMBER = r"regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"


def _promoted(kind: str, names: str) -> str:
    """The first castable value of a column's names, with the name it came from."""
    good = "e.v is not null" if kind == "string" else "e.v is not null and " + _IS_NUMBER.replace("(v,", "(e.v,")
    return "coalesce(" + ", ".join(f"list_filter(entries, lambda e: e.field = '{n}' and {good})[1]" for n in names.split(",")) + ")"


#: Every line as typed columns; what no column took is kept as JSON, but for empty values of approved fields.
_TABLE = f"""
rows as (
  select n.file_id, n.series_id, r.line_no, n.names[:len(c.vals)] as names, c.vals[:len(n.names)] as vals
  from (select file_id, line_no, arg_min(record, record_id) as record from calibration_records group by all) r join named n using (file_id)
  join cells c on c.file_id = r.file_id and c.line_no is not distinct from r.line_no and c.record = r.record),
entered as (
  select file_id, series_id, line_no, list_transform(list_zip(names, vals), lambda z: {{'field': z[1], 'raw': z[2], 'v': case when trim(z[2]) = '' or lower(trim(z[2])) = 'nan' then null else trim(z[2]) end}}) as entries from rows),
picked as (select *, {", ".join(f"{_promoted(k, a)} as p_{n}" for n, (k, a) in CALIBRATION.items())} from entered),
rest as (
  select *, list_filter(entries, lambda e: not list_contains([{", ".join(f"p_{n}.field" for n in CALIBRATION)}], e.field)
    and not (e.v is null and list_contains([{", ".join(f"'{n}'" for n in CALIBRATION)}], e.field))) as kept_back from picked)
select file_id, series_id, line_no, {", ".join(f"p_{n}.v as {n}" if k == "string" else f"cast(p_{n}.v as double) as {n}" for n, (k, _) in CALIBRATION.items())},
  case when len(kept_back) > 0 then cast(to_json(map_from_entries(list_transform(kept_back, lambda e: {{'k': e.field, 'v': e.raw}}))) as varchar) end as rescued, cast(null as varchar) as extra
from rest
"""

SQL: dict[str, str] = {
    "p5_table": f"with {_DRIFT}, {_TABLE}",
    "p1_found": f"with {_ORPHANS} select table_name, row_id, reason from orphans",
    "p1_counts": f"with {_ORPHANS} select table_name, date_trunc('month', moment) as period, reason, count(*) as n_rows, count(distinct k) as n_keys from orphans group by all",
    "p3_found": f"with {_DIFF} select utt_id, measure, kind from found",
    "p3_counts": f"with {_DIFF} select measure, kind, count(*) as n from found group by all",
    "p4_found": f"""
with t as (
  select lower(trim(session)) as session, lower(trim(pass)) as pass, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
  from segmentation where session is not null and pass is not null and not isnan(start_sec) and not isnan(end_sec)),
m as (select *, max(e) over (partition by session, pass order by s, e rows between unbounded preceding and 1 preceding) as reach from t where e > s),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by session, pass order by s, e rows unbounded preceding) as island from m),
p as (select session, pass, island, min(s) as start_ms, max(e) as end_ms from i group by all),
g as (select session, pass, lag(end_ms) over (partition by session, pass order by start_ms) as start_ms, start_ms as end_ms from p)
select session, pass, 'period' as kind, start_ms, end_ms from p
union all select session, pass, 'gap', start_ms, end_ms from g where end_ms - start_ms < {BREAK_MS}""",
    "p5_found": f"""
with {_DRIFT}
select file_id, field, 'renamed' as change, new_field from renamed
union all select file_id, field, 'added', '' from fresh f where not exists (select 1 from renamed r where r.file_id = f.file_id and r.new_field = f.field)
union all select file_id, field, 'removed', '' from gone g where not exists (select 1 from renamed r where r.file_id = g.file_id and r.field = g.field)
union all select p.file_id, a.field, 'type', '' from pairs p join fields a on a.file_id = p.file_id join fields b on b.file_id = p.prev and b.field = a.field where a.class <> b.class""",
}
