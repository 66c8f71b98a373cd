"""DuckDB SQL with the same results as pipeline_queries."""

from __future__ import annotations

from takeloom.functions.text import normalized_sql, number_words_sql
from takeloom.functions.wer import counts_sql
from takeloom.plans.core_queries import MEASURES
from takeloom.plans.pipeline_queries import HEAVY, NUMBERS, PERCENTS, SEEDS, SHR_GRID


def _last(name: str, k: str, columns: str, tie: str = "row_id") -> str:
    return f"select lower(trim({k})) as {k}, {columns} from {name} where trim({k}) <> '' qualify row_number() over (partition by lower(trim({k})) order by loaded_at desc, {tie} desc) = 1"


_KEY = r"'^([^_]+)_(.+)_([cdf][0-9]{3,})$'"
ITEMS = f"items_ as ({_last('items', 'item_id', 'lower(trim(item_type)) as item_type, text')})"
SAMPLE = f"sample as ({_last('annotation_sample', 'utt_id', 'lower(trim(pass)) as pass, creak_doubling_rate, wav_path')})"
HAND = f"hand as ({_last('hand_annotation', 'utt_id', 'lower(trim(pass)) as pass, hand_creak_proportion, n_tokens, n_creaky')})"


def _acoustics(name: str, alias: str) -> str:
    return f"{alias} as ({_last(name, 'utt_id', 'lower(trim(pass)) as pass, ' + ', '.join(MEASURES), 'pass')})"


V1, V2 = _acoustics("acoustics_v1", "v1"), _acoustics("acoustics_v2", "v2")
CLIPS = "clips as (select seg_id, lower(trim(session)) as session, lower(trim(pass)) as pass, lower(trim(item_id)) as item_id, position, start_sec, end_sec, match_ratio, flag from segmentation where session is not null and pass is not null)"
TIMED = f"{CLIPS}, timed as (select * from clips where not isnan(start_sec) and not isnan(end_sec) and end_sec > start_sec)"
DURATIONS = "durations as (select session, pass, max(end_sec) + 1.0 as duration from timed group by all)"
DELIVERIES = """deliveries as (select lower(trim(item_id)) as item_id, first(text order by loaded_at, row_id) as script_text, last(text order by loaded_at, row_id) as last_text, last(lower(trim(item_type)) order by loaded_at, row_id) as item_type
  from items where trim(item_id) <> '' group by 1)"""
QUEUE = f"""{CLIPS}, {ITEMS}, queue as (select seg_id, session, pass, c.item_id, match_ratio, case when coalesce(match_ratio, 0) = 0 then 'unmatched' when match_ratio < 0.8 then 'low_confidence' else 'ok' end as sure, text as script_text
  from clips c left join items_ i on i.item_id = c.item_id where coalesce(match_ratio, 0) < 1 or coalesce(flag, '') <> 'ok')"""
HEAVY_SQL = "coalesce(list_has_any(string_split(coalesce(f0_quality_flag, ''), ';'), [" + ", ".join(f"'{h}'" for h in HEAVY) + "]), false)"
PROBLEMS = f"""{SAMPLE}, {V2}, problems as (select coalesce(s.utt_id, a.utt_id) as utt_id, case when a.utt_id is null then 'missing_from_measured' when s.utt_id is null then 'missing_from_manifest' when {HEAVY_SQL} then 'heavy_intervention' end as problem
  from sample s full join v2 a on a.utt_id = s.utt_id)"""
LINE = "o as (select *, lag(end_sec) over w as prev_end, lead(start_sec) over w as next_start, lag(seg_id) over w as prev_id, max(end_sec) over (partition by session, pass order by start_sec, seg_id rows between unbounded preceding and 1 preceding) as reach from timed window w as (partition by session, pass order by start_sec, seg_id))"
LABELLED = f"""{HAND}, {V2}, labelled as (select v2.*, case when isnan(hand_creak_proportion) then null else hand_creak_proportion > 0.5 end as creaky from v2 join hand using (utt_id))"""
NUM = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"


def _value(c: str) -> str:
    t = f"trim(cast({c} as varchar))"
    return f"case when {t} = '' or lower({t}) = 'nan' then null else {t} end"


def _diff() -> str:
    parts = " union all ".join(f"select a.utt_id, '{m}' as measure, {_value('a.' + m)} as x, {_value('b.' + m)} as y from v1 a join v2 b using (utt_id)" for m in MEASURES)
    num = lambda c: f"case when regexp_full_match({c}, '{NUM}') then cast({c} as double) end"
    same = lambda c: f"case when lower({c}) in ('true', 'false') then lower({c}) else coalesce({c}, '') end"
    return f"""{V1}, {V2}, longs as ({parts}), n as (select *, {num('x')} as a, {num('y')} as b from longs),
diff as (select utt_id, measure, case when a is not null and b is not null then 'numeric' else 'text' end as kind, b - a as delta,
  case when a is null or b is null then null when a <> 0 then (b - a) / abs(a) * 100 when b = 0 then 0.0 else cast('inf' as double) end as pct_change, coalesce(a > 0 and b < 0 or a < 0 and b > 0, false) as sign_changed,
  case when a is not null and b is not null then a <> b else {same('x')} <> {same('y')} end as changed from n)"""


NUMBERED = "numbered as (select *, substr(item_id, 1, 1) as kind, ltrim(substr(item_id, 2), '0') as number from items_ where regexp_full_match(item_id, '[cdf][0-9]{3,}'))"
_HEAD = "left(number, len(number) - len(regexp_extract(number, '9*$')))"
#: The next number in digits.
NEXT = f"(case when {_HEAD} = '' then '1' else left({_HEAD}, len({_HEAD}) - 1) || cast(cast(right({_HEAD}, 1) as int) + 1 as varchar) end) || repeat('0', len(regexp_extract(number, '9*$')))"
PAIRS = f"""{ITEMS}, {NUMBERED}, t as (select item_id, kind, number, {normalized_sql('text')} as tokens from numbered where text is not null),
one as (select kind, number, {NEXT} as later, first(tokens order by item_id) as tokens, min(item_id) as item_id from t group by all),
pairs as (select a.item_id, a.kind, a.tokens as ref, b.tokens as hyp from one a join one b on b.kind = a.kind and b.number = a.later),
counted as (select item_id, kind, len(ref) as n, {counts_sql('ref', 'hyp')} as e from pairs),
wers as (select item_id, kind, e.s as substitutions, e.d as deletions, e.i as insertions, n as reference_length, case when n > 0 then round(e.c / n, 6) when e.c = 0 then 0.0 else cast('inf' as double) end as wer from counted)"""


def _grid(value: str, grid: str, test: str, rows: str = "labelled") -> str:
    return f"""select g as threshold, tp, fp, pos - tp as fn, n, pos from (select g, count(*) filter (creaky and {test}) as tp, count(*) filter (not creaky and {test}) as fp, count(*) filter (creaky) as pos, count(*) as n
  from (select unnest({grid}) as g) cross join {rows} where not isnan({value}) and creaky is not null group by g)"""


_PRF = "coalesce(tp / nullif(tp + fp, 0), 0.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as r"
_F1 = "case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end"


def _best(name: str, value: str, grid: str, test: str) -> str:
    return f"""select '{name}' as component, threshold, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, round(trivial, 6) as trivial_f1, n, abs(threshold - lo) < 1e-6 or abs(threshold - hi) < 1e-6 as at_edge, f1 - trivial < 0.01 as degenerate
from (select *, {_F1} as f1, 2 * (pos / n) / (1 + pos / n) as trivial, min(threshold) over () as lo, max(threshold) over () as hi from (select *, {_PRF} from ({_grid(value, grid, test)})))
qualify row_number() over (order by f1 desc, threshold) = 1"""


SHR = "[" + ", ".join(map(str, SHR_GRID)) + "]::double[]"
H1H2 = "list_transform(range(0, 141), lambda i: -30 + 0.5::double * i)"
JITTER = "list_transform(range(0, 301), lambda i: round(0.1::double * i, 1))"
PERCENT_ROWS = f"""ref as (select list(f0_median_hz order by f0_median_hz) as v from v2 where pass = 'a_modal' and not isnan(f0_median_hz)),
cuts as (select unnest([{", ".join(map(str, PERCENTS))}]::double[]) as percent),
places as (select percent, v, (len(v) - 1) * (percent / 100) as h from cuts cross join ref),
cutoffs as (select percent, v[cast(floor(h) as bigint) + 1] + (h - floor(h)) * (v[least(cast(floor(h) as bigint) + 2, len(v))] - v[cast(floor(h) as bigint) + 1]) as cutoff from places),
pc as (select percent, cutoff, count(*) filter (creaky and f0_median_hz <= cutoff + 1e-9) as tp, count(*) filter (not creaky and f0_median_hz <= cutoff + 1e-9) as fp, count(*) filter (creaky and f0_median_hz > cutoff + 1e-9) as fn, count(*) as n
  from cutoffs cross join labelled where not isnan(f0_median_hz) and creaky is not null group by all),
exact as (select percent, cutoff, p as precision, r as recall, {_F1} as f1, n from (select *, {_PRF} from pc)),
graded as (select percent, round(cutoff, 6) as cutoff, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, n from exact)"""
MS = "cast(round({} * 1000) as bigint)"
PERIODS = f"""c2 as (select seg_id, session, pass, flag, {MS.format('start_sec')} as s, {MS.format('end_sec')} as e from timed),
pm as (select *, max(e) over (partition by session, pass order by s, e rows between unbounded preceding and 1 preceding) as reach from c2 where flag = 'ok' and e > s),
pi as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by session, pass order by s, e rows unbounded preceding) as island from pm),
periods as (select session, pass, min(s) as start_ms, max(e) as end_ms from pi group by session, pass, island)"""

CONFORM_SQL = " , ".join(f"case when coalesce({c} {op} {v}, false) then null else '{c}' end" for c, op, v in (("lang", "=", "'en'"), ("doc_kind", "=", "'log'"), ("n_chars", "<=", "2000")))
_EDGE = "[!-/:-@\\[-`{-~]+"


def simple_sql(text: str) -> str:
    """The plainer words of a text."""
    return f"list_filter(list_transform(regexp_split_to_array(lower(trim({text}, ' ')), '[ \\t\\n\\v\\f\\r]+'), lambda w: regexp_replace(w, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda w: w <> '')"


READ = f"""{ITEMS}, {NUMBERED}, read as (select kind || left(number, greatest(len(number) - 2, 0)) as take, item_id, cast('0' || right(number, 2) as int) as position, list_transform({simple_sql('text')}, lambda w: item_id || ':' || w) as tokens from numbered)"""
#: What of each item was heard, and when: its words but for the last one at every third position, and then a word of none.
HEARD = f"""{READ}, said as (select *, coalesce(len(tokens), 0) as n, case when position % 3 = 0 and len(tokens) > 0 then 1 else 0 end as lost from read),
timed as (select *, n - lost as m, position * 6000.0::double + coalesce(sum(case when tokens is null then 0 else n - lost + 1 end) over (partition by take, position order by item_id rows between unbounded preceding and 1 preceding), 0) / 2.0::double as moment from said)"""


def _scored(r: str, ref: str) -> str:
    """Columns of a score struct r against the token list ref."""
    return f"{r}.s as {r}_substitutions, {r}.d as {r}_deletions, {r}.i as {r}_insertions, len({ref}) as {r}_reference_length, case when len({ref}) > 0 then {r}.c / len({ref}) when {r}.c = 0 then 0.0 else cast('inf' as double) end as {r}_wer, substr({r}.a, 2) as {r}_alignment"


SQL: dict[str, str] = {
    "nonconforming_documents": f"select doc_id, array_to_string(list_filter([{CONFORM_SQL}], lambda f: f is not null), ',') as failed from documents where len(list_filter([{CONFORM_SQL}], lambda f: f is not null)) > 0",
    "review_order": f"""with {QUEUE} select q.seg_id, q.match_ratio, row_number() over (order by coalesce(case when isnan(q.match_ratio) then null else q.match_ratio end, -1), q.pass nulls first, q.session nulls first, position nulls first, q.seg_id) as rank
from queue q join clips c on c.seg_id = q.seg_id""",
    "flagged_report": f"with {CLIPS} select seg_id, flag, match_ratio, row_number() over (order by coalesce(case when isnan(match_ratio) then null else match_ratio end, -1), seg_id) as rank from clips where coalesce(flag, '') <> 'ok'",
    "flag_counts": f"with {CLIPS} select 'flag' as \"column\", flag as value, count(*) as n from clips group by all union all select 'pass', pass, count(*) from clips group by all",
    "dropped_rates": f"with {SAMPLE} select pass, count(*) as n, count(*) filter (creak_doubling_rate is null or isnan(creak_doubling_rate)) as n_dropped from sample group by all",
    "built_file_names": f"with {CLIPS} select seg_id, session || '_' || pass || '_' || item_id as utt_id, session || '_' || pass || '_' || item_id || '.wav' as file_name from clips",
    "block_names": f"""with {CLIPS}, n as (select distinct session || '_pass' || pass || '_block' as name from clips), k as (select *, regexp_full_match(name, '([^_]+)_pass((.|\\n)+)_block') as parsed from n)
select name, parsed, case when parsed then regexp_extract(name, '^([^_]+)_pass(.+)_block$', 1) end as session, case when parsed then regexp_extract(name, '^([^_]+)_pass(.+)_block$', 2) end as pass from k""",
    "first_utterances": f"with {SAMPLE} select utt_id, pass from sample order by utt_id limit 100",
    "customer_nations": "select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey",
    "unmatched_items": f"with {ITEMS}, o as (select lower(trim(item_id)) as item_id from stimulus_orders where trim(item_id) <> '') select item_id, count(*) as n from o where item_id not in (select item_id from items_) group by 1",
    "joined_one_to_one": f"""with {SAMPLE}, {HAND}, {V2} select utt_id, s.pass, s.creak_doubling_rate, h.pass as hand_pass, h.n_tokens, a.pass as measured_pass, a.creak_doubling_rate as measured_creak_doubling_rate, a.f0_n_frames
from sample s join hand h using (utt_id) join v2 a using (utt_id)""",
    "odd_pass_sessions": """with r as (select distinct lower(trim(session)) as session, lower(trim(pass)) as pass from segmentation where session is not null and pass is not null) select session, count(*) as n from r group by 1
having count(*) <> 3 or count(*) filter (pass = 'a_modal') <> 1 or count(*) filter (pass = 'b_natural') <> 1 or count(*) filter (pass = 'c_creak') <> 1""",
    "list_sizes": "select list_id, lower(trim(pass)) as pass, count(*) as n from stimulus_orders group by 1, 2 having count(*) <> 100",
    "unblinded": f"with {SAMPLE}, n as (select utt_id, pass, row_number() over (order by md5('20270607:' || utt_id), utt_id) as annotation_order from sample) select *, annotation_order % 3 as answer from n",
    "take_report": f"""with {CLIPS}, known as (select distinct lower(trim(pass)) as pass from stimulus_orders where trim(pass) <> ''), good as (select * from clips where pass in (select pass from known)),
named as (select * from good where item_id is not null), have as (select session, pass, item_id, count(*) as n from named group by all), want as (select distinct u.session, u.pass, e.item_id from (select distinct session, pass from named) u join named e on e.session = u.session),
q as (select * from good where start_sec is not null and end_sec is not null and not isnan(start_sec) and not isnan(end_sec)), o as (select *, lag(end_sec) over w as prev_end, lag(seg_id) over w as prev_id from q window w as (partition by session, pass order by start_sec, seg_id)),
pairs as (select distinct unnest([seg_id, prev_id]) as seg_id from o where start_sec < prev_end)
select session, pass, item_id, seg_id, 'unknown_pass' as category from clips where pass not in (select pass from known)
union all select w.session, w.pass, w.item_id, null, case when h.n is null then 'missing' else 'duplicate' end from want w left join have h using (session, pass, item_id) where h.n is null or h.n > 1
union all select * from (select session, pass, item_id, seg_id, case when start_sec is null or end_sec is null or isnan(start_sec) or isnan(end_sec) then 'missing_boundary' when end_sec - start_sec <= 0 then 'non_positive' when end_sec - start_sec < 0.5 or end_sec - start_sec > 12 then 'out_of_range' end as issue from good) where issue is not null
union all select session, pass, item_id, seg_id, 'overlap' from good where seg_id in (select seg_id from pairs)""",
    "clip_texts": f"""with {TIMED}, {PERIODS}, p as (select c2.seg_id, c2.session, c2.pass, c2.s, item_id, (s + e) / 2.0::double as at_ms from c2 join timed t on t.seg_id = c2.seg_id where coalesce(c2.flag, '') <> 'ok' and item_id is not null),
a as (select p.*, l.start_ms as ls, l.end_ms as le from p asof left join periods l on l.session = p.session and l.pass = p.pass and l.start_ms <= p.at_ms),
b as (select a.*, r.start_ms as rs from a asof left join periods r on r.session = a.session and r.pass = a.pass and r.start_ms > a.at_ms),
c as (select *, case when coalesce(at_ms < le, false) or rs is null or coalesce(at_ms - le <= rs - at_ms, false) then ls else rs end as clip_start from b)
select session, pass, clip_start, string_agg(item_id, ' ' order by s, seg_id) as text from c group by session, pass, clip_start""",
    "speech_rates": f"with {TIMED}, {ITEMS}, w as (select item_id, len({normalized_sql('text')}) as n from items_ where text is not null) select seg_id, round(n / (end_sec - start_sec), 6) as words_per_sec from timed join w using (item_id)",
    "stratified_sample": f"""with {SAMPLE}, r as (select *, row_number() over (order by creak_doubling_rate, utt_id) as rn, count(*) over () as n from sample where pass is not null and not isnan(creak_doubling_rate)),
t as (select utt_id, pass, case when rn <= n // 3 then 'low' when rn <= 2 * n // 3 then 'mid' else 'high' end as tercile from r),
u as (select *, row_number() over (partition by tercile, pass order by md5('20270607:' || utt_id), utt_id) as turn from t)
select utt_id, pass, tercile from u qualify row_number() over (partition by tercile order by turn, pass, utt_id) <= 30""",
    "stratum_supply": f"""with {SAMPLE}, r as (select row_number() over (order by creak_doubling_rate, utt_id) as rn, count(*) over () as n from sample where pass is not null and not isnan(creak_doubling_rate)),
t as (select case when rn <= n // 3 then 'low' when rn <= 2 * n // 3 then 'mid' else 'high' end as tercile, count(*) as k from r group by 1)
select tercile, coalesce(k, 0) as available, greatest(1000 - coalesce(k, 0), 0) as short from (select unnest(['low', 'mid', 'high']) as tercile) left join t using (tercile)""",
    "sequence_alignment": f"""with {HEARD} select take, item_id, cast(n as int) as n_expected, cast(m as int) as n_matched, case when n > 0 then round(m / n, 4) else 0.0 end as match_ratio, case when m > 0 then moment end as start_sec, case when m > 0 then moment + (m - 1) / 2.0::double + 0.375 end as end_sec,
case when m = 0 then 'unmatched' when m / n < 0.8 then 'low_confidence' else 'ok' end as flag from timed""",
    # between two matched words: an insertion if no expected word is lost there
    "sequence_insertions": f"""with {HEARD}, g as (select *, sum(case when m > 0 then 1 else 0 end) over (partition by take order by position, item_id rows unbounded preceding) as run from timed)
select take, min(moment + m / 2.0::double) as start_sec, max(moment + m / 2.0::double + 0.375) as end_sec, string_agg('um:' || item_id, ' ' order by position, item_id) as text from g where tokens is not null group by take, run having sum(lost) = 0""",
    "expected_stream": f"with {READ}, x as (select take, item_id, position, unnest(tokens) as token, generate_subscripts(tokens, 1) as place from read) select take, item_id, position, cast(place as int) as place, token from x",
    "items_without_words": f"with {READ} select take, item_id, position from read where coalesce(len(tokens), 0) = 0",
    "simple_words": f"select row_id, array_to_string({simple_sql('text')}, ' ') as words from items",
    "wer_alignment": f"with {PAIRS}, a as (select item_id, {counts_sql('ref', 'hyp', True)} as e from pairs) select item_id, e.s as s, e.d as d, e.i as i, substr(e.a, 2) as alignment from a",
    "scored_one_reference": f"with {PAIRS}, a as (select item_id as utt_id, ref, {counts_sql('ref', 'hyp', True)} as verbatim from pairs) select utt_id, {_scored('verbatim', 'ref')} from a",
    "scored_two_references": f"""with {PAIRS}, {DELIVERIES}, y as (select d.item_id, d.script_text as verbatim_text, array_to_string(p.hyp, ' ') as script_text, last_text as hypothesis, coalesce({normalized_sql('last_text')}, []) as heard, coalesce({normalized_sql('d.script_text')}, []) as own, p.hyp as after from deliveries d join pairs p using (item_id)),
z as (select *, {counts_sql('own', 'heard', True)} as verbatim, {counts_sql('after', 'heard', True)} as script from y) select item_id, verbatim_text, script_text, hypothesis, {_scored('verbatim', 'own')}, {_scored('script', 'after')} from z""",
    "version_presence": f"with {V1}, {V2} select coalesce(a.utt_id, b.utt_id) as utt_id, case when b.utt_id is null then 'left' else 'right' end as side from v1 a full join v2 b on a.utt_id = b.utt_id where a.utt_id is null or b.utt_id is null",
    "header_difference": """with a as (select column_name as c from (describe select * from acoustics_v1)), b as (select column_name as c from (describe select * from acoustics_v2))
select c as "column", 'only_left' as side from a where c not in (select c from b) union all select c, 'only_right' from b where c not in (select c from a)""",
    "distinct_changed": f"with {_diff()} select count(distinct utt_id) as n_keys, count(distinct utt_id) filter (changed) as n_changed, count(distinct utt_id) filter (sign_changed) as n_sign_changed, count(*) filter (changed) as n_values from diff",
    "winning_thresholds": f"with {LABELLED}, b as (" + " union all ".join(f"({_best(n, n, g, t)})" for n, g, t in (("shr_median", SHR, "shr_median > g"), ("h1_h2_db_mean", H1H2, "h1_h2_db_mean < g"), ("jitter_local_pct", JITTER, "jitter_local_pct > g"))) + ") select component, threshold from b where not degenerate",
    "threshold_applied": f"with {V2} select utt_id, case when isnan(shr_median) then null else shr_median > 0.38 end as predicted from v2",
    # the quantile of t by its expansion around the normal one, exact to more digits than are shown for groups of this size
    "ols_confidence": """with l as (select l_returnflag, count(*) as n, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, avg(l_quantity) as mx, regr_sxx(l_extendedprice, l_quantity) as sxx,
  sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)) as se from lineitem group by 1),
q as (select *, z + (z ** 3 + z) / (4 * v) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * v ** 2) + (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / (384 * v ** 3) as t from (select *, 1.959963984540054::double as z, cast(n - 2 as double) as v from l)),
x as (select *, 1.0::double + k * (49.0::double / 99) as x from q, range(100) r(k)), f as (select *, a + b * x as fit, t * se * sqrt(1.0::double / n + (x - mx) ** 2 / sxx) as half from x)
select l_returnflag, round(x, 6) as x, round(fit, 3) as fit, round(fit - half, 3) as low, round(fit + half, 3) as high from f""",
    "scatter_points": f"with {HAND}, {SAMPLE} select utt_id, hand_creak_proportion as y, sample.pass, creak_doubling_rate as x from hand join sample using (utt_id) where not isnan(hand_creak_proportion) and not isnan(creak_doubling_rate)",
    "stream_resume_score": f"select row_id, cast(len({normalized_sql('text')}) as int) as n_tokens, cast(0 as bigint) as new_again from items",
    "inventory_conformance": "select source, count(*) as n, count(*) filter (lang = 'en' and doc_kind = 'log' and n_chars <= 2000) as n_conforming, count(*) filter (doc_kind in ('forum', 'mail', 'note')) as n_lossy from documents group by all",
    "duplicate_text_collisions": "select md5(text) as digest, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from documents where text is not null group by 1 having count(*) > 1",
    "stale_annotations": """with a as (select lower(trim(utt_id)) as utt_id, max(loaded_at) as t from annotation_key where trim(utt_id) <> '' group by 1), b as (select lower(trim(utt_id)) as utt_id, max(loaded_at) as t from hand_annotation where trim(utt_id) <> '' group by 1)
select utt_id, case when b.t is null then 'missing' else 'older' end as reason from a left join b using (utt_id) where b.t is null or a.t > b.t""",
    "dense_item_ids": "select c_custkey, p || case when len(n) < 3 then lpad(n, 3, '0') else n end as item_id from (select c_custkey, substr(c_mktsegment, 1, 1) as p, cast(row_number() over (partition by substr(c_mktsegment, 1, 1) order by c_custkey) as varchar) as n from customer)",
    "deterministic_orders": " union all ".join(f"select p_partkey, '{p}' as pass, row_number() over (order by md5('{s}:' || p_partkey), p_partkey) as position from part" for p, s in SEEDS.items()),
    "parse_composite_key": r"""with k as (select row_id, trim(utt_id) as u, coalesce(regexp_full_match(trim(utt_id), '([^_]+)_(.+)_([CDF][0-9]{3,})'), false) as parsed from annotation_key)
select row_id, parsed, case when parsed then regexp_extract(u, '^([^_]+)_(.+)_([CDF][0-9]{3,})$', 1) end as session, case when parsed then regexp_extract(u, '^([^_]+)_(.+)_([CDF][0-9]{3,})$', 2) end as pass, case when parsed then regexp_extract(u, '^([^_]+)_(.+)_([CDF][0-9]{3,})$', 3) end as item_id from k""",
    "flag_tokens_overlap": f"with {V2} select pass, count(*) as n, count(*) filter ({HEAVY_SQL}) as n_heavy from v2 group by all",
    "review_queue": f"with {QUEUE} select * from queue",
    "finalize_gate": f"with {QUEUE} select seg_id, session, pass, item_id from queue where trim(coalesce(script_text, '')) = '' and coalesce(match_ratio, 0) < 0.85",
    "reference_fallback": f"with {DELIVERIES} select item_id, v as verbatim_text, v is distinct from script_text as was_corrected from (select *, case when trim(coalesce(last_text, '')) <> '' then last_text else script_text end as v from deliveries)",
    "copy_paste_rate": f"""with {DELIVERIES}, c as (select item_type, count(*) filter (trim(coalesce(last_text, '')) <> '') as n_filled, count(*) filter (trim(coalesce(last_text, '')) <> '' and last_text is not distinct from script_text) as n_same from deliveries group by all)
select *, coalesce(n_same / nullif(n_filled, 0), 0.0) as rate, coalesce(n_same / nullif(n_filled, 0), 0.0) > 0.2 as too_many from c""",
    "manifest_join_with_errors": f"""with {SAMPLE}, {ITEMS}, {HAND}, k as (select *, regexp_matches(utt_id, {_KEY}) as parsed, nullif(regexp_extract(utt_id, {_KEY}, 2), '') as p, nullif(regexp_extract(utt_id, {_KEY}, 3), '') as item_id from sample)
select k.utt_id, k.item_id, case when not parsed then 'parse' when i.item_id is null then 'item' when h.utt_id is null then 'reference' when k.p is distinct from k.pass then 'pass' end as error
from k left join items_ i on i.item_id = k.item_id left join hand h on h.utt_id = k.utt_id""",
    "join_problem_report": f"with {PROBLEMS} select utt_id, problem from problems where problem is not null",
    "joined_excluding": f"""with {PROBLEMS} select utt_id, a.pass, case when isnan(a.creak_doubling_rate) then null else a.creak_doubling_rate end as creak_doubling_rate, s.wav_path from sample s join v2 a using (utt_id)
where utt_id not in (select utt_id from problems where problem is not null)""",
    "one_to_one_guard": " union all ".join(f"select '{t}' as frame, cast(sum(n) as bigint) as n_rows, count(k) as n_keys, count(*) filter (n > 1) as n_repeated from (select lower(trim(utt_id)) as k, count(*) as n from {t} group by 1)" for t in ("annotation_sample", "annotation_key", "hand_annotation", "acoustics_v1", "acoustics_v2")),
    "resume_antijoin": "select doc_id, source from documents d where not exists (select 1 from abuse_labels l where l.doc_id = d.doc_id)",
    "grid_names_compared": """with a as (select distinct lower(trim(utt_id)) as utt_id from annotation_key where trim(utt_id) <> ''), b as (select distinct lower(trim(utt_id)) as utt_id from hand_annotation where trim(utt_id) <> '')
select coalesce(a.utt_id, b.utt_id) as utt_id, case when b.utt_id is null then 'left' else 'right' end as side from a full join b on a.utt_id = b.utt_id where a.utt_id is null or b.utt_id is null""",
    "list_coverage": """with r as (select list_id, lower(trim(pass)) as pass, lower(trim(item_id)) as item_id from stimulus_orders where trim(item_id) <> ''),
have as (select *, count(*) as n from r where list_id is not null and pass is not null group by all), want as (select distinct u.list_id, u.pass, e.item_id from (select distinct list_id, pass from r where list_id is not null and pass is not null) u join r e on e.list_id = u.list_id)
select list_id, pass, item_id, case when h.n is null then 'missing' else 'duplicate' end as issue, coalesce(h.n, 0) as n from want w left join have h using (list_id, pass, item_id) where h.n is null or h.n > 1""",
    "list_positions": """select list_id, lower(trim(pass)) as pass, count(*) as n, count(distinct position) as "distinct", min(position) as lowest, max(position) as highest from stimulus_orders group by 1, 2
having count(distinct position) <> count(*) or min(position) is null or min(position) <> 1 or max(position) <> count(*)""",
    "plausibility_violations": f"with {V2}, {HAND} select utt_id, pass, shr_median, h1_h2_db_mean from v2 where not isnan(shr_median) and shr_median > 0.45 and not isnan(h1_h2_db_mean) and h1_h2_db_mean > 2 and utt_id not in (select utt_id from hand)",
    "interval_issues": f"""with {TIMED}, q as (select * from clips where not isnan(start_sec) and not isnan(end_sec)), o as (select *, lag(end_sec) over w as prev_end, lag(seg_id) over w as prev_id from q window w as (partition by session, pass order by start_sec, seg_id)),
l as (select seg_id, session, pass, case when start_sec is null or end_sec is null or isnan(start_sec) or isnan(end_sec) then 'missing_boundary' when end_sec - start_sec <= 0 then 'non_positive' when end_sec - start_sec < 0.5 or end_sec - start_sec > 12 then 'out_of_range' end as issue from clips)
select * from l where issue is not null union all select distinct unnest([seg_id, prev_id]) as seg_id, session, pass, 'overlap' from o where start_sec < prev_end""",
    "running_overlaps": f"with {TIMED}, {LINE} select seg_id, session, pass, reach from o where start_sec < reach",
    "padded_bounds": f"""with {TIMED}, {DURATIONS}, {LINE} select seg_id, session, pass, round(greatest(start_sec - 0.150::double, coalesce((prev_end + start_sec) / 2, 0), 0), 6) as padded_start,
round(least(end_sec + 0.150::double, coalesce((end_sec + next_start) / 2, duration), duration), 6) as padded_end from o join durations using (session, pass)""",
    "gap_fill_timeline": f"""with {TIMED}, {DURATIONS}, {LINE}
select session, pass, case when start_sec < coalesce(reach, 0) then 'overlap' else 'span' end as kind, start_sec as start, end_sec as end, coalesce(flag, '') as label from o
union all select session, pass, 'gap', coalesce(reach, 0), start_sec, '' from o where start_sec > coalesce(reach, 0)
union all select session, pass, 'gap', max(end_sec), any_value(duration), '' from timed join durations using (session, pass) group by session, pass""",
    "merged_fragments": f"""with {TIMED}, {LINE}, e as (select distinct session, pass, end_sec as boundary from timed where flag = 'ok'),
good as (select distinct o.session, o.pass, o.prev_end from o join e on e.session = o.session and e.pass = o.pass and abs(o.prev_end - e.boundary) <= 0.005 + 1e-9),
m as (select o.*, sum(case when o.prev_end is null or g.prev_end is not null then 1 else 0 end) over (partition by o.session, o.pass order by o.start_sec, o.seg_id rows unbounded preceding) as island from o left join good g using (session, pass, prev_end))
select session, pass, min(start_sec) as start_sec, max(end_sec) as end_sec, count(*) as n, count(distinct trim(coalesce(flag, ''))) > 1 as conflict from m group by session, pass, island""",
    "time_weighted_share": f"""with {TIMED}, sp as (select session, pass, min(start_sec) as a, max(end_sec) as b from timed group by all)
select session, pass, count(*) as n, count(*) filter (flag = 'ok') as n_holding, round(coalesce(sum(end_sec - start_sec) filter (flag = 'ok'), 0) / sum(end_sec - start_sec), 6) as share, round(avg(((start_sec + end_sec) / 2 - a) / (b - a)) filter (flag = 'ok'), 6) as mean_position
from timed join sp using (session, pass) group by session, pass""",
    "event_runs": """with o as (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from o)
select user_id, min(event_type) as event_type, min(ts) as first, max(ts) as last, count(*) as n from r group by user_id, run""",
    "point_in_interval_nearest": f"""with {TIMED}, {PERIODS}, p as (select seg_id, session, pass, (s + e) // 2 as at_ms from c2 where coalesce(flag, '') <> 'ok'),
a as (select p.*, l.start_ms as ls, l.end_ms as le from p asof left join periods l on l.session = p.session and l.pass = p.pass and l.start_ms <= p.at_ms),
b as (select a.*, r.start_ms as rs, r.end_ms as re from a asof left join periods r on r.session = a.session and r.pass = a.pass and r.start_ms > a.at_ms)
select seg_id, session, pass, at_ms, coalesce(at_ms < le, false) as inside, case when coalesce(at_ms < le, false) or rs is null or coalesce(at_ms - le <= rs - at_ms, false) then ls else rs end as start_ms,
case when coalesce(at_ms < le, false) or rs is null or coalesce(at_ms - le <= rs - at_ms, false) then le else re end as end_ms from b""",
    "boundaries_in_tolerance": f"with {TIMED} select distinct a.session, a.pass, a.seg_id from timed a join timed b on b.session = a.session and b.pass = a.pass and b.item_id is distinct from a.item_id and abs(a.start_sec - b.start_sec) <= 0.005 + 1e-9 and abs(a.end_sec - b.end_sec) <= 0.005 + 1e-9 where a.flag = 'ok'",
    "greedy_pack": f"""with recursive {TIMED}, o as (select seg_id, session, pass, round((end_sec - start_sec) * 1000) as ms, row_number() over (partition by session, pass order by seg_id) as k from timed),
w as (select *, 1::bigint as batch, 0.0::double as batch_offset from o where k = 1
  union all select o.*, case when w.batch_offset + w.ms + 500 + o.ms > 25000 then w.batch + 1 else w.batch end, case when w.batch_offset + w.ms + 500 + o.ms > 25000 then 0.0 else w.batch_offset + w.ms + 500 end from w join o on o.session = w.session and o.pass = w.pass and o.k = w.k + 1)
select seg_id, session, pass, ms, batch, batch_offset from w""",
    "tercile_roundrobin_sample": f"""with {SAMPLE}, r as (select *, row_number() over (order by creak_doubling_rate, utt_id) as rn, count(*) over () as n from sample where pass is not null and not isnan(creak_doubling_rate)),
t as (select utt_id, pass, case when rn <= n // 3 then 'low' when rn <= 2 * n // 3 then 'mid' else 'high' end as tercile from r),
u as (select *, row_number() over (partition by tercile, pass order by md5('20270607:' || utt_id), utt_id) as turn from t)
select utt_id, pass, tercile from u qualify row_number() over (partition by tercile order by turn, pass, utt_id) <= 20""",
    "annotation_order": f"with {SAMPLE} select utt_id, row_number() over (order by md5('20270607:' || utt_id), utt_id) as annotation_order from sample",
    "topk_by_measure": f"with {V2} select utt_id, shr_median from v2 where pass = 'c_creak' and not isnan(shr_median) order by shr_median desc, utt_id limit 20",
    "topk_threshold_exclude": f"with {V2}, {HAND} select utt_id, f0_median_hz from v2 where pass = 'c_creak' and shr_median > 0.3 and not isnan(shr_median) and not isnan(f0_median_hz) and utt_id not in (select utt_id from hand) order by f0_median_hz desc, utt_id limit 20",
    "topk_forced": """with c as (select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING'), f as (select c_custkey from c order by c_custkey limit 2)
select c_custkey, c_acctbal from c order by c_custkey in (select c_custkey from f) desc, c_acctbal desc, c_custkey limit 10""",
    "nearest_median": f"""with {V2}, m as (select *, median(f0_median_hz) over (partition by pass) as mid from v2 where pass is not null and not isnan(f0_median_hz))
select pass, utt_id, f0_median_hz from m qualify row_number() over (partition by pass order by abs(f0_median_hz - mid), utt_id) <= 5""",
    "strata_union": f"""with {V2}, h as (select utt_id from v2 where pass = 'c_creak' and not isnan(shr_median) order by shr_median desc, utt_id limit 20),
m as (select *, median(f0_median_hz) over (partition by pass) as mid from v2 where pass is not null and not isnan(f0_median_hz) and utt_id not in (select utt_id from h)),
n as (select utt_id from m qualify row_number() over (partition by pass order by abs(f0_median_hz - mid), utt_id) <= 5)
select utt_id, 'highest' as stratum from h union all select utt_id, 'median' from n""",
    "normalize_tokens": f"select row_id, array_to_string({normalized_sql('text')}, ' ') as normalized from items",
    "number_words": f"select o_orderkey, {number_words_sql('cast(o_orderkey as varchar)', True)} as words from orders",
    "wer_counts": f"with {PAIRS} select item_id, substitutions, deletions, insertions, reference_length, wer from wers",
    "wer_pooled_by_group": f"""with {PAIRS} select kind, cast(sum(reference_length) as bigint) as reference_length, round(sum(substitutions) / sum(reference_length), 6) as substitution_rate, round(sum(deletions) / sum(reference_length), 6) as deletion_rate,
round(sum(insertions) / sum(reference_length), 6) as insertion_rate, round(avg(wer), 6) as mean_wer from wers group by all""",
    "wer_gap_two_refs": f"""with {PAIRS}, {DELIVERIES}, y as (select d.item_id, {normalized_sql('last_text')} as heard, {normalized_sql('script_text')} as own, p.hyp as after from deliveries d join pairs p using (item_id) where last_text is not null and script_text is not null),
z as (select {counts_sql('own', 'heard')}.c as a, len(own) as la, {counts_sql('after', 'heard')}.c as b, len(after) as lb from y)
select round(sum(a) / sum(la), 6) as own_rate, round(sum(b) / sum(lb), 6) as next_rate, round(sum(b) / sum(lb) - sum(a) / sum(la), 6) as gap from z""",
    "version_diff": f"with {_diff()} select utt_id, measure, kind, round(delta, 6) as delta, round(pct_change, 6) as pct_change, sign_changed from diff where changed",
    "sign_changes": f"with {_diff()} select utt_id, measure from diff where changed and sign_changed",
    "most_changed": f"with {_diff()} select measure, count(*) as n from diff where changed group by 1 order by n desc, measure limit 10",
    "symmetric_flags": f"with {V2}, m as (" + " union all ".join(f"select '{m}' as measure, avg({m}) filter (not isnan({m}) and split_part(utt_id, '_', 1) = 's01') as a, avg({m}) filter (not isnan({m}) and split_part(utt_id, '_', 1) = 's02') as b from v2" for m in NUMBERS) + """)
select measure, round(a, 9) as first, round(b, 9) as second, round(d, 9) as pct_diff, coalesce(d > 15, false) as flagged from (select *, case when a = 0 and b = 0 then 0.0 else abs(a - b) / ((abs(a) + abs(b)) / 2) * 100 end as d from m)""",
    "threshold_grid": f"with {LABELLED} select threshold, round(p, 6) as precision, round(r, 6) as recall, round({_F1}, 6) as f1, n, pos as positives from (select *, {_PRF} from ({_grid('shr_median', SHR, 'shr_median > g')}))",
    "threshold_best": f"with {LABELLED} " + " union all ".join(f"({_best(n, n, g, t)})" for n, g, t in (("shr_median", SHR, "shr_median > g"), ("h1_h2_db_mean", H1H2, "h1_h2_db_mean < g"), ("jitter_local_pct", JITTER, "jitter_local_pct > g"))),
    "percentile_grid": f"with {LABELLED}, {PERCENT_ROWS} select * from graded",
    "percentile_plateau": f"""with {LABELLED}, {PERCENT_ROWS}, b as (select *, abs(f1 - max(f1) over ()) < 1e-9 as tie from exact), g as (select *, sum(case when tie then 0 else 1 end) over (order by percent) as island from b)
select min(percent) as percent, round(first(cutoff order by percent), 6) as cutoff, round(max(f1), 6) as f1, max(percent) as plateau_percent, round(last(cutoff order by percent), 6) as plateau_cutoff from g where tie group by island order by min(percent) limit 1""",
    "prf_by_group": f"""with {LABELLED}, k as (select pass, count(*) filter (creaky and shr_median > 0.38) as tp, count(*) filter (not creaky and shr_median > 0.38) as fp, count(*) filter (creaky and not shr_median > 0.38) as fn, count(*) as n from labelled where creaky is not null and not isnan(shr_median) group by all)
select pass, round(p, 6) as precision, round(r, 6) as recall, round({_F1}, 6) as f1, n from (select *, {_PRF} from k)""",
    "trivial_f1": f"with {LABELLED} select pass, round(case when avg(creaky::int) > 0 then 2 * avg(creaky::int) / (1 + avg(creaky::int)) else 0 end, 6) as trivial_f1 from labelled where creaky is not null group by all",
    "group_stats": f"""with {HAND}, h as (select pass, hand_creak_proportion as v from hand where pass is not null and not isnan(hand_creak_proportion))
select coalesce(pass, 'all') as pass, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(median(v), 6) as median, round(min(v), 6) as min, round(max(v), 6) as max from h group by rollup (pass)""",
    "zscore": "select o_orderkey, round((o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over (), 6) as z from orders",
    "pearson": f"with {HAND}, {SAMPLE} select count(*) as n, round(corr(hand_creak_proportion, creak_doubling_rate), 6) as r from hand join sample using (utt_id) where not isnan(hand_creak_proportion) and not isnan(creak_doubling_rate)",
    "ttest": """with m as (select l_linestatus as g, count(*) as n, avg(l_discount) as m, var_pop(l_discount) as v from lineitem where l_linestatus in ('O', 'F') group by 1), t as (select a.n as n1, b.n as n2, a.m as m1, b.m as m2, (a.n * a.v + b.n * b.v) / (a.n + b.n - 2) as v from m a, m b where a.g = 'F' and b.g = 'O')
, s as (select n1 + n2 - 2 as df, (m1 - m2) / sqrt(v * (1.0::double / n1 + 1.0::double / n2)) as t, m1, m2 from t),
-- the density between 0 and t by the rule of Simpson
area as (select sum(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end * exp(-(df + 1) / 2.0::double * ln(1 + x * x / df))) * any_value(step) / 3 as a from (select df, abs(t) / 2000 as step, k * abs(t) / 2000 as x, k from s, range(2001) r(k)))
select df, round(t, 6) as t, round(1 - 2 * a * exp(lgamma((df + 1) / 2.0::double) - lgamma(df / 2.0::double)) / sqrt(df * pi()), 6) as p, round(m1, 6) as mean_first, round(m2, 6) as mean_second from s, area""",
    "anova_f": """with m as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, var_pop(o_totalprice) as v from orders group by 1), t as (select count(*) as k, sum(n) as n, sum(n * m) as s, sum(n * m * m) as q, sum(n * v) as w from m)
, u as (select ((q - s * s / n) / (k - 1)) / (w / (n - k)) as f, cast(k - 1 as double) as d1, cast(n - k as double) as d2 from t),
-- the density between 0 and f by the rule of Simpson; it is 0 at 0 for more than two groups
area as (select sum(case when i = 2000 then 1 when i % 2 = 1 then 4 else 2 end * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(x) - (d1 + d2) / 2 * ln(1 + d1 * x / d2))) * any_value(f) / 2000 / 3 as a
  from (select *, i * f / 2000 as x from u, range(1, 2001) r(i)))
select round(f, 6) as f, round(1 - a, 6) as p, cast(d1 as bigint) as df_between, cast(d2 as bigint) as df_within from u, area""",
    "ols_line": """select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(avg(l_quantity), 4) as mean_x,
round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) as residual_se from lineitem group by 1""",
    "nan_rate": " union all ".join(f"select '{m}' as measure, round(avg(({m} is null or isnan({m}))::int), 6) as rate from acoustics_v2" for m in NUMBERS),
    "session_means": f"""with {V2} select split_part(utt_id, '_', 1) as session, round(avg(f0_median_hz) filter (not isnan(f0_median_hz)), 9) as f0, round(avg(shr_median) filter (not isnan(shr_median)), 9) as shr,
{", ".join(f"round(avg(f0_median_hz) filter (not isnan(f0_median_hz) and pass = '{p}'), 9) as f0_{p[0]}" for p in ("a_modal", "b_natural", "c_creak"))} from v2 group by 1""",
    "decibels": "select event_id, case when value > 0 then round(20 * log10(value), 6) end as db from events",
    "value_percentiles": "select user_id, round(quantile_cont(value, 0.1) filter (value > 0), 6) as p10, round(quantile_cont(value, 0.5) filter (value > 0), 6) as p50, round(quantile_cont(value, 0.9) filter (value > 0), 6) as p90, round(avg((value > 0)::int), 6) as share from events group by 1",
}
