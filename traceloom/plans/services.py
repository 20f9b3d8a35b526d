"""Access, policies and calendars: plans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import dates, text as T
from traceloom.operators import access
from traceloom.plans.activity import SESSIONS, SLICES, buckets, day_ledger_sql
from traceloom.plans.retrieval import EVTEXT, LIVE
from traceloom.store import table
from traceloom.streaming import stateful

NOW = 1_612_000_000_000


def grant(spark, sf_dir, level="evidence", days=30):
    apps = [r["bundle_id"] for r in table(spark, sf_dir, "apps").where("id <= 3").select("bundle_id").collect()]
    return access.Grant("client", tuple(apps), days, level)


def narrative_numbers(s, d):
    rows = table(s, d, "documents").where("text is not null and title is not null")
    return rows.select("doc_id", F.size(access.unfaithful_numbers(F.col("title"), F.col("text"))).alias("invented"))


QUERIES = {
    "grant_rows": lambda s, d: access.scoped(s, d, grant(s, d), NOW).select("device_id", "id", "ts", "app_id"),
    "grant_none": lambda s, d: access.scoped(s, d, None, NOW).select("device_id", "id"),
    "grant_masked": lambda s, d: access.masked(s, d, grant(s, d, "summary"), NOW),
    "grant_texts": lambda s, d: access.masked(s, d, grant(s, d), NOW),
    "grant_days": lambda s, d: access.day_apps(s, d, grant(s, d)),
    "tool_search": lambda s, d: access.Tools(s, d, access.Grant("c", days=100), NOW).search("query planner", 20),
    "tool_timeline": lambda s, d: access.Tools(s, d, access.Grant("c", days=100), NOW).get_timeline("hour", period="7d"),
    "stream_window_counts": stateful.window_counts,
    "app_policies": access.app_policies,
    "completeness_classes": access.completeness,
    "audited_rows": access.audited,
    "frame_gate": access.frame_gate,
    "json_lines": access.hit_lines,
    "narrative_sessions": access.narrative_sessions,
    "narrative_backlog": access.narrative_backlog,
    "narrative_numbers": narrative_numbers,
    "bucket_labels": lambda s, d: table(s, d, "documents").where("captured_at is not null").select("doc_id", *(dates.bucket_label(F.unix_millis(F.col("captured_at").cast("timestamp")), k).alias(k) for k in ("hour", "day", "week")), dates.weekday(F.unix_millis(F.col("captured_at").cast("timestamp"))).alias("weekday")),
    "day_texts": lambda s, d: table(s, d, "text_versions").select("vrow", dates.day_text(F.col("created_at")).alias("day"), dates.stamp(F.col("created_at")).alias("stamp")),
    "durations": lambda s, d: table(s, d, "text_versions").select("vrow", T.duration_text(F.col("created_at") % 10_000_000).alias("length")),
}

ALLOWED = "app_id in (select id from apps where id <= 3)"
GRANT = f"{LIVE}, g as (select * from obs where {ALLOWED} and ts >= {NOW} - 30 * 86400000::bigint and ts <= {NOW})"
HEXBITS = lambda a: f"('0x' || substr(frame_hash, {a}, 8))::ubigint::bigint"
SQL = {
    "grant_rows": f"with {GRANT} select device_id, id, ts, app_id from g",
    "grant_none": "select device_id, id from observations limit 0",
    "grant_masked": f"with {GRANT} select device_id, id, ts, app_id, null::varchar as text from g",
    "grant_texts": f"with {GRANT}, {EVTEXT} select device_id, id, ts, app_id, text from g left join tx using (device_id, id)",
    "grant_days": f"with {day_ledger_sql('app')} select day, count(*) as apps, sum(dwell_ms) as dwell_ms, sum(active_ms) as active_ms, sum(unknown_ms) as unknown_ms, sum(observations) as observations, sum(switches) as switches from led where app in (select id from apps where id <= 3) group by 1",
    "stream_window_counts": "with o as (select distinct * from observations where ts is not null and deleted_at is null) select ts // 3600000 * 3600000 as start_ts, app_id, count(*) as observations from o group by 1, 2",
    "app_policies": "select lower(bundle_id) as bundle_id, min(name) as name, min(case when starts_with(name, 'Tide') then 'summary' else 'full' end) as policy, max(case when starts_with(name, 'Tide') then 'stored' else 'default' end) as source from apps group by 1",
    "completeness_classes": f"with {LIVE}, h as (select distinct device_id, observation_id as id, true as has from occ) select case when source_state <> 'ok' then 'state' when has then case when window_id is null then 'text' else 'whole' end else 'empty' end as class, completeness, count(*) as observations from obs left join h using (device_id, id) group by 1, 2",
    "audited_rows": f"with {LIVE}, k as (select device_id, coalesce(display_id, -1) as display, id, row_number() over (partition by device_id, coalesce(display_id, -1) order by ts, id) as k from obs where ts is not null and completeness <> 'unavailable') select device_id, display, id from k where k % 50 = 0",
    "frame_gate": f"with {LIVE}, h as (select device_id, window_id, id, ts, {HEXBITS(1)} as a, {HEXBITS(9)} as b from obs where ts is not null and frame_hash is not null), l as (select *, lag(a) over w as pa, lag(b) over w as pb from h window w as (partition by device_id, window_id order by ts, id)) select device_id, window_id, id, bit_count(xor(a, pa)) + bit_count(xor(b, pb)) as bits from l where pa is not null and bit_count(xor(a, pa)) + bit_count(xor(b, pb)) <= 6",
    "json_lines": f"with {LIVE} select device_id, id, '{{' || concat_ws(',', '\"device_id\":\"' || device_id || '\"', '\"id\":' || id, '\"ts\":' || ts, '\"trigger\":\"' || \"trigger\" || '\"') || '}}' as json from obs",
    "narrative_sessions": f"with {SESSIONS}, r as (select *, start_ts // 86400000 as day, row_number() over (partition by start_ts // 86400000 order by dwell_ms desc, start_ts, device_id, display, app) as k from sess) select day, row_number() over (partition by day order by start_ts, device_id, display, app) as n, device_id, app, start_ts, dwell_ms, case when dwell_ms >= 3600000 then (dwell_ms // 3600000)::varchar || 'h ' || (dwell_ms // 60000 % 60)::varchar || 'm' when dwell_ms >= 60000 then (dwell_ms // 60000)::varchar || 'm ' || (dwell_ms // 1000 % 60)::varchar || 's' else (dwell_ms // 1000)::varchar || 's' end as length from r where k <= 5",
    "narrative_backlog": f"with {SLICES}, {buckets(86400000)}, d as (select distinct bucket as day from c where ms > 0 or inside = 1) select day from d where day < (select max(day) from d) and day >= (select max(day) from d) - 7",
    "bucket_labels": "select doc_id, strftime(captured_at, '%Y-%m-%d %H:00') as hour, strftime(captured_at, '%Y-%m-%d') as day, strftime(captured_at, '%G-W%V') as week, isodow(captured_at)::int as weekday from documents where captured_at is not null",
    "day_texts": "select vrow, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') as day, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d %H:%M') as stamp from text_versions",
    "durations": "with d as (select vrow, created_at % 10000000 // 1000 as s from text_versions) select vrow, case when s >= 3600 then (s // 3600)::varchar || 'h ' || (s % 3600 // 60)::varchar || 'm' when s >= 60 then (s // 60)::varchar || 'm ' || (s % 60)::varchar || 's' else s::varchar || 's' end as length from d",
}
