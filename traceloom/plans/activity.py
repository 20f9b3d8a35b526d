"""Slices, sessions, ledgers and patterns: plans and their SQL."""

from __future__ import annotations

from traceloom.operators import ledger, patterns, slices

SLICES = """
    live as (select distinct device_id, id, ts, coalesce(display_id, -1) as display, coalesce(app_id, -1) as app, window_id, url_id, file_id, source_state
        from observations where deleted_at is null and origin_device is null and ts is not null),
    s as (select *, least(coalesce(lead(ts) over (partition by device_id, display order by ts, id), ts), ts + 90000) as "end",
            case when source_state in ('permission_lost', 'timeout', 'locked') then 'unknown' when source_state = 'user_idle' then 'idle' else 'active' end as kind
        from live)"""
SESSIONS = f"""{SLICES},
    p as (select *, lag(app) over (partition by device_id, display order by ts, id) as papp, lag(ts) over (partition by device_id, display, app order by ts, id) as pts from s),
    b as (select *, case when pts is null then 1 when papp = app then (ts - pts >= 300000)::int else (ts - pts > 20000)::int end as begins from p),
    n as (select *, sum(begins) over (partition by device_id, display, app order by ts, id rows unbounded preceding) as session,
            case when begins = 0 and papp <> app then 1 else 0 end as returns from b),
    sess as (select device_id, display, app, session, min(ts) as start_ts, max("end") as end_ts,
            sum(case when kind <> 'unknown' then "end" - ts else 0 end) as dwell_ms, sum(case when kind = 'active' then "end" - ts else 0 end) as active_ms,
            sum(case when kind = 'unknown' then "end" - ts else 0 end) as unknown_ms, sum(returns) as interruptions, count(*) as observations
        from n group by 1, 2, 3, 4)"""


def buckets(size: int, source: str = "s") -> str:
    return f"""
    u as (select *, unnest(generate_series(ts // {size}, greatest(("end" - 1) // {size}, ts // {size}))) as bucket from {source}),
    c as (select *, greatest(0, least("end", (bucket + 1) * {size}) - greatest(ts, bucket * {size})) as ms, (ts // {size} = bucket)::int as inside from u)"""


SUMS = """sum(case when kind <> 'unknown' then ms else 0 end)::bigint as dwell_ms, sum(case when kind = 'active' then ms else 0 end)::bigint as active_ms,
    sum(case when kind = 'unknown' then ms else 0 end)::bigint as unknown_ms, sum(inside)::bigint as observations"""


def day_ledger_sql(key: str) -> str:
    return f"""{SLICES}, {buckets(86400000)},
    each as (select bucket as day, {key}, {SUMS} from c where {key} is not null and {key} <> -1 and (ms > 0 or inside = 1) group by 1, 2),
    sw as (select ts // 86400000 as day, {key}, (lag({key}) over (partition by device_id, display, ts // 86400000 order by ts, id) is distinct from {key})::int as sw from s where {key} is not null and {key} <> -1),
    led as (select each.*, coalesce(x.n, 0)::bigint as switches from each left join (select day, {key}, sum(sw) as n from sw group by 1, 2) x on x.day = each.day and x.{key} = each.{key})"""


UNION = """
    iv as (select ts, "end" from s where kind <> 'unknown' and "end" > ts),
    cut as (select h, greatest(ts, h * 3600000) as lo, least("end", (h + 1) * 3600000) as hi from (select *, unnest(generate_series(ts // 3600000, ("end" - 1) // 3600000)) as h from iv)),
    mk as (select *, max(hi) over (partition by h order by lo, hi rows between unbounded preceding and 1 preceding) as far from cut),
    rn as (select *, sum(case when lo <= far then 0 else 1 end) over (partition by h order by lo, hi rows unbounded preceding) as r from mk),
    onl as (select h // 24 as day, sum(len)::bigint as online_ms from (select h, r, max(hi) - min(lo) as len from rn group by 1, 2) group by 1),
    tot as (select bucket as day, {sums} from c where ms > 0 or inside = 1 group by 1),
    days as (select tot.*, coalesce(online_ms, 0) as online_ms from tot left join onl using (day))""".replace("{sums}", SUMS)


def timeline_sql(size: int) -> str:
    return f"""with {SLICES}, {buckets(size)},
    each as (select bucket, {SUMS} from c where ms > 0 or inside = 1 group by 1),
    tops as (select bucket, arg_min(app, (-ms, app)) as top_app from (select bucket, app, sum(ms)::bigint as ms from c where (ms > 0 or inside = 1) and app <> -1 and kind <> 'unknown' group by 1, 2) group by 1),
    spine as (select unnest(generate_series((select min(bucket) from each), (select max(bucket) from each))) as bucket)
    select bucket * {size} as start_ts, coalesce(dwell_ms, 0) as dwell_ms, coalesce(active_ms, 0) as active_ms, coalesce(unknown_ms, 0) as unknown_ms, coalesce(observations, 0) as observations, top_app
    from spine left join each using (bucket) left join tops using (bucket)"""


HEAT = f"""{SLICES}, {buckets(3600000)},
    each as (select bucket, {SUMS} from c where ms > 0 or inside = 1 group by 1),
    spine as (select unnest(generate_series((select min(bucket) from each), (select max(bucket) from each))) as bucket),
    heat as (select ((bucket // 24 + 3) % 7 + 1)::int as weekday, (bucket % 24)::int as hour, count(*) as slots, coalesce(sum(dwell_ms), 0)::bigint as dwell_ms, coalesce(sum(active_ms), 0)::bigint as active_ms,
            coalesce(sum(unknown_ms), 0)::bigint as unknown_ms, coalesce(sum(observations), 0)::bigint as observations
        from spine left join each using (bucket) group by 1, 2)"""
FOCUS = """{s},
    p as (select *, lag(ts) over w as pts, lag(kind) over w as pk from s window w as (partition by device_id, display order by ts, id)),
    r as (select *, sum(case when pts is null or ts - pts >= 20000 or kind = 'unknown' or pk = 'unknown' then 1 else 0 end) over (partition by device_id, display order by ts, id rows unbounded preceding) as run from p),
    a as (select device_id, display, run, app, min(ts) as lo, max(greatest("end", ts)) as hi, sum("end" - ts) as ms, sum(case when kind = 'active' then "end" - ts else 0 end) as act from r where kind <> 'unknown' group by 1, 2, 3, 4),
    f as (select device_id, display, min(lo) as start_ts, max(hi) - min(lo) as duration_ms, count(*) as apps, arg_min(app, (-ms, app)) as top_app, sum(act) / nullif(sum(ms), 0) as active_ratio
        from a group by device_id, display, run having max(hi) - min(lo) >= {least})"""
LEAST = 60_000  # runs of the test tables are short; the library's default is 25 minutes

QUERIES = {
    "slices": lambda s, d: slices.slices(s, d).select("device_id", "display", "id", "ts", "end", "app", "kind"),
    "sessions": lambda s, d: slices.sessions(s, d),
    "sessions_overlapping": lambda s, d: slices.overlapping_sessions(s, d, 1_610_000_000_000, 1_610_600_000_000).select("device_id", "display", "app", "start_ts", "end_ts"),
    "session_intervals": slices.session_intervals,
    "session_rollup": ledger.session_rollup,
    "day_ledger_apps": ledger.day_ledger,
    "day_ledger_sites": lambda s, d: ledger.day_ledger(s, d, "url_id"),
    "day_ledger_files": lambda s, d: ledger.day_ledger(s, d, "file_id"),
    "day_totals": ledger.day_totals,
    "display_dwell": ledger.display_dwell,
    "timeline_hour": lambda s, d: ledger.timeline(s, d, ledger.HOUR),
    "timeline_day": lambda s, d: ledger.timeline(s, d, ledger.DAY),
    "week_ledger": ledger.week_ledger,
    "week_days": ledger.week_days,
    "observation_days": ledger.observation_days,
    "heat_map": patterns.heat_map,
    "heat_marginals": patterns.marginals,
    "peak_cell": patterns.peak_cell,
    "app_patterns": patterns.app_patterns,
    "transitions": patterns.transitions,
    "focus_blocks": lambda s, d: patterns.focus_blocks(s, d, LEAST),
    "focus_stats": lambda s, d: patterns.focus_stats(s, d, LEAST),
    "session_stats": patterns.session_stats,
    "active_days": patterns.active_days,
    "activity_page": patterns.activity_page,
    "recent_activity": lambda s, d: patterns.recent_activity(s, d, 1440),
    "gpu_budget": patterns.daily_gpu_budget,
}

SQL = {
    "slices": f'with {SLICES} select device_id, display, id, ts, "end", app, kind from s',
    "sessions": f"with {SESSIONS} select * exclude (session) from sess",
    "sessions_overlapping": f"with {SESSIONS} select device_id, display, app, start_ts, end_ts from sess where start_ts < 1610600000000 and end_ts > 1610000000000",
    "session_intervals": f"with {SESSIONS}, g as (select *, id - row_number() over (partition by device_id, display, app, session order by id) as r from n) select device_id, display, app, session, min(id) as lo, max(id) as hi from g group by device_id, display, app, session, r",
    "session_rollup": f"with {SESSIONS} select app, count(*) as sessions, sum(dwell_ms) as dwell_ms, sum(active_ms) as active_ms, sum(unknown_ms) as unknown_ms from sess group by 1",
    "day_ledger_apps": f"with {day_ledger_sql('app')} select * from led",
    "day_ledger_sites": f"with {day_ledger_sql('url_id')} select * from led",
    "day_ledger_files": f"with {day_ledger_sql('file_id')} select * from led",
    "day_totals": f"with {SLICES}, {buckets(86400000)}, {UNION} select * from days",
    "display_dwell": f"with {SLICES}, {buckets(86400000)} select bucket as day, device_id, display, sum(ms) as dwell_ms from c where kind <> 'unknown' group by 1, 2, 3 having sum(ms) > 0",
    "timeline_hour": timeline_sql(3600000),
    "timeline_day": timeline_sql(86400000),
    "week_ledger": f"with {day_ledger_sql('app')} select (day + 3) // 7 as week, app, sum(dwell_ms) as dwell_ms, sum(active_ms) as active_ms, sum(unknown_ms) as unknown_ms, sum(observations) as observations, sum(switches) as switches, count(distinct day) as active_days from led group by 1, 2",
    "week_days": f"with {SLICES}, {buckets(86400000)}, {UNION}, spine as (select week, unnest(generate_series(week * 7 - 3, week * 7 + 3)) as day from (select distinct (day + 3) // 7 as week from days)) select week, day, dwell_ms is not null as has_data, coalesce(dwell_ms, 0) as dwell_ms, coalesce(observations, 0) as observations from spine left join days using (day)",
    "observation_days": "select unnest(generate_series((select min(ts) // 86400000 from observations where deleted_at is null), (select max(ts) // 86400000 from observations where deleted_at is null))) as day",
    "heat_map": f"with {HEAT} select *, dwell_ms / slots as mean_dwell_ms from heat where dwell_ms + unknown_ms + observations > 0",
    "heat_marginals": f"with {HEAT}, k as (select 'hour' as axis, unnest(generate_series(0, 23))::int as value union all select 'weekday', unnest(generate_series(1, 7))::int), m as (select 'hour' as axis, hour as value, sum(dwell_ms) as dwell_ms, sum(observations) as observations from heat group by 2 union all select 'weekday', weekday, sum(dwell_ms), sum(observations) from heat group by 2) select axis, value, coalesce(dwell_ms, 0) as dwell_ms, coalesce(observations, 0) as observations from k left join m using (axis, value)",
    "peak_cell": f"with {HEAT} select weekday, hour, dwell_ms from heat order by dwell_ms desc, weekday * 100 + hour limit 1",
    "app_patterns": f"""with {SLICES}, {buckets(3600000)}, e as (select app, bucket % 24 as hour, sum(ms)::bigint as ms, min(ts) as lo, max(ts) as hi from c where app <> -1 and kind <> 'unknown' group by 1, 2),
        k as (select *, row_number() over (partition by app order by ms desc, hour) as k from e)
        select app, sum(ms)::bigint as dwell_ms, min(lo) as first_ts, max(hi) as last_ts, coalesce(string_agg(hour::varchar, ',' order by k) filter (k <= 3 and ms > 0), '') as top_hours, sum(ms) / nullif(sum(sum(ms)) over (), 0) as share from k group by app""",
    "transitions": f"with {SLICES}, p as (select app, ts, lag(app) over w as pa, lag(ts) over w as pt from s where app <> -1 window w as (partition by device_id, display order by ts, id)) select pa as from_app, app as to_app, count(*) as changes, avg(ts - pt) as mean_gap_ms from p where pa <> app and ts - pt <= 90000 group by 1, 2 order by changes desc, 1, 2 limit 20",
    "focus_blocks": "with " + FOCUS.format(s=SLICES, least=LEAST) + " select * from f",
    "focus_stats": "with " + FOCUS.format(s=SLICES, least=LEAST) + " select count(*) as blocks, sum(duration_ms) as total_ms, avg(duration_ms) as mean_ms, median(duration_ms) as median_ms, max(duration_ms) as longest_ms, count(*) filter (apps = 1) as single_app, count(*) filter (active_ratio >= 0.5) as active_half from f",
    "session_stats": f"with {SESSIONS}, l as (select *, end_ts - start_ts as ms from sess) select count(*) as sessions, avg(ms) as mean_ms, quantile_disc(ms, 0.5) as median_ms, quantile_disc(ms, 0.9) as p90_ms, max(ms) as longest_ms, sum(dwell_ms) as dwell_ms, sum(interruptions) as interruptions from l",
    "active_days": f"with {SLICES} select count(distinct ts // 86400000) as days from s",
    "activity_page": f"with {SLICES} select ts, device_id, id, app, display from s order by ts desc, device_id desc, id desc limit 50",
    "recent_activity": f"with {SLICES} select app, count(*) as observations, max(ts) as last_ts from s where ts > (select max(ts) from s) - 86400000 group by 1",
    "gpu_budget": f'with {SLICES}, h as (select device_id, ts // 86400000 as day, ts // 3600000 as hour, sum("end" - ts) as ms from s group by 1, 2, 3) select device_id, hour, sum(ms) over (partition by device_id, day order by hour) as used_ms from h',
}
