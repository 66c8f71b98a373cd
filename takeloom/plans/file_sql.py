"""DuckDB SQL with the same results as file_queries."""

from __future__ import annotations

from takeloom.plans.file_queries import NAMES, STEP, WANTED
from takeloom.plans.pipeline_sql import H1H2, JITTER, LABELLED, READ, SHR, _best, simple_sql

_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_WANTED = ", ".join(f"'{w}'" for w in sorted(WANTED))
#: Words of the deliveries as intervals, numbered from 0, with the number of words of their document.
PHONES = f"""words as (select row_id, {simple_sql('text')} as words from items), phones as (select row_id, 'r' || row_id as doc_id, {_NAMES}[row_id % 3 + 1] as tier, len(words) as n, unnest(range(len(words))) as k, unnest(words) as word from words),
marked as (select *, substr(word, 1, 1) in ({_WANTED}) as wanted, k - row_number() over (partition by doc_id, substr(word, 1, 1) in ({_WANTED}) order by k) as run from phones)"""
#: The tier to annotate: each word that counts, and the runs of others.
BLANK = f"""{PHONES}, blank as (select doc_id, row_id, n, wanted, min(k) as a, max(k) + 1 as b from marked group by doc_id, row_id, n, wanted, run, case when wanted then k else -1 end)"""
_BAD = "row_id % 7 = 0 or row_id % 11 = 0 or row_id % 13 = 0"
_NAME = r"regexp_replace(regexp_replace(coalesce(wav_path, ''), '^.*/', ''), '\.[^.]*$', '')"
_TIERS = f"""{READ}, tiers as (select take as doc_id, 'items' as tier, position * 60.0::double as start, position * 60.0::double + 60 as "end", item_id || ' "' || coalesce(tokens[1], '') || '"' as label from read
  union all select take, 'sizes', position * 60.0::double, position * 60.0::double + 60, cast(len(tokens) as varchar) from read where len(tokens) > 0)"""

SQL: dict[str, str] = {
    "csv_typed": "select row_id, nullif(item_id, '') as item_id, nullif(item_type, '') as item_type, nullif(text, '') as text from items",
    "csv_keyed": "select c_custkey, c_name, c_nationkey, c_acctbal from customer",
    "csv_text": "select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation",
    "open_schema": """with c as (select column_name as c, row_number() over () as k from (describe select * from acoustics_v2)) select row_number() over (order by case c when 'pass' then 0 when 'utt_id' then 1 else 2 end, k) as place, c as "column" from c where c <> 'loaded_at'""",
    "text_files": "select n_nationkey, cast(1 as bigint) as n_files, strlen(n_name) + 1 as bytes from nation",
    "listings": "select 'all' as listing, count(*) as n_files from nation union all select 'without', count(*) from nation where n_nationkey <> 3 union all select 'flat', 1",
    "not_made": "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation where n_nationkey % 2 = 1",
    "wav_lengths": "select 'n' || n_nationkey || '.wav' as name, (4000 + 1000 * n_nationkey) / 8000.0::double as duration_sec, 8000 as sample_rate, 1 as channels from nation union all select 'none.WAV', null, null, null",
    "probed_files": """with d as (select doc_id, lang, doc_kind, coalesce(n_chars, 0) as n_chars from documents) select doc_id, case when n_chars % 5 <> 0 then coalesce(lang, '') else '' end as codec_name, case when n_chars % 5 <> 0 then coalesce(doc_kind, '') else '' end as sample_fmt, case when n_chars % 5 <> 0 then cast(n_chars as varchar) else '' end as sample_rate,
case when n_chars % 5 = 0 then '' when n_chars % 3 = 1 then '24' else '16' end as bit_depth, case when n_chars % 5 <> 0 then '1' else '' end as channels, case when n_chars % 5 <> 0 and n_chars % 2 = 0 then cast(n_chars / 8 as varchar) when n_chars = 0 then '0.0' else cast(n_chars / 4 as varchar) end as duration_sec,
case when n_chars % 7 <> 0 then cast(n_chars * 8 as varchar) else '' end as bit_rate, cast(n_chars as varchar) as size_bytes, case when n_chars % 5 = 0 then 'no audio stream' end as error from d""",
    "manifest_records": """select cast(c_custkey as varchar) as key, c_mktsegment || ', "etc"' as segment from customer where c_custkey % 7 <> 0""",
    "tidied_clips": """select seg_id, row_number() over (order by session nulls first, pass nulls first, position nulls first, seg_id) as row, case when isnan(start_sec) then null else cast(round(cast(start_sec as decimal(24, 9)), 2) as double) end as start_sec, case when isnan(end_sec) then null else cast(round(cast(end_sec as decimal(24, 9)), 2) as double) end as end_sec,
case when isnan(match_ratio) then null else cast(round(cast(match_ratio as decimal(24, 9)), 3) as double) end as match_ratio, n_whisper_words_matched as n_matched from segmentation""",
    "frozen_settings": f"with {LABELLED}, b as (" + " union all ".join(f"({_best(n, n, g, t)})" for n, g, t in (("shr_median", SHR, "shr_median > g"), ("h1_h2_db_mean", H1H2, "h1_h2_db_mean < g"), ("jitter_local_pct", JITTER, "jitter_local_pct > g")))
    + f") select component as name, threshold as value from b where not degenerate union all select '{','.join(sorted(WANTED))}', null",
    "tier_choice": f"with {PHONES} select doc_id, tier, count(*) as n from phones group by all",
    "annotation_tiers": f"""with {BLANK} select doc_id, 'creak' as tier, a * {STEP}::double as start, b * {STEP}::double as "end", '' as label, cast(null as varchar) as error from blank""",
    "grid_measures": f"""with {PHONES}, m as (select doc_id, any_value(row_id) as row_id, any_value(n) as n, count(*) filter (wanted) as tokens, count(*) filter (wanted and k % 3 = 0) as creaky, avg((k + 0.5) / n) filter (wanted and k % 3 = 0) as mean_position from marked group by doc_id),
e as (select *, case when row_id % 7 = 0 then null when row_id % 11 = 0 then 'unexpected labels [''x'']' when row_id % 13 = 0 then 'an extra boundary at 0.125 separates ''c'' and ''''' when row_id % 17 = 0 then 'no creak tier' end as given from m),
f as (select *, coalesce(given, case when tokens = 0 then 'no tokens' end) as error from e)
select doc_id, error, case when error is null then cast(tokens as int) end as n_tokens, case when error is null then cast(creaky as int) end as n_creaky, case when error is null then round(creaky / tokens, 6) end as proportion,
case when error is null then round(mean_position, 6) end as mean_position, case when error is null then case when row_id % 7 = 0 then 1 else 0 end end as n_merged from f""",
    "carrier_ends": f"""with {PHONES}, c as (select doc_id, max((k + 1) * {STEP}::double) filter (substr(word, 1, 1) = 't') as start, any_value(n * {STEP}::double + case when row_id % 2 = 1 then 0.005::double else 0 end) as "end" from phones group by 1)
select doc_id, start, round("end", 6) as "end" from c where "end" - start >= 0.01""",
    "textgrid_round_trip": f"with {_TIERS} select *, cast(null as varchar) as error from tiers",
    "repeated_labels": f"with {_TIERS} select doc_id, tier, label, count(*) as n from tiers where trim(label) <> '' group by all having count(*) > 1",
    "spelled_hypotheses": f"""select cast(row_id as varchar) as utt_id, case when trim({_NAME}) <> '' then lower(replace({_NAME}, '_', ' ')) end as hypothesis, 'spelled' as recognizer, case when trim({_NAME}) = '' then 'no file name' end as error from annotation_key""",
}
