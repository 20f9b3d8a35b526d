"""Building, deleting and checking the store: plans and their SQL."""

from __future__ import annotations

from traceloom.operators import deletion, writes
from traceloom.plans.activity import SESSIONS

OBS = "obs as (select distinct * from observations), occ as (select distinct * from occurrences)"
NOW = 1_640_000_000_000
QUOTA_SHARE = 2


def largest_app(spark, sf_dir):
    """Bundle of the app with id 1, for deletions by app."""
    row = deletion.table(spark, sf_dir, "apps").where("id = 1").first()
    return row["bundle_id"] if row else ""


def quota(spark, sf_dir):
    from pyspark.sql import functions as F

    return (deletion.table(spark, sf_dir, "text_versions").agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUOTA_SHARE


QUERIES = {
    "apps_from_feed": writes.apps_from_feed,
    "versions_shown": writes.versions_shown,
    "late_texts": writes.late_texts,
    "window_latest": writes.window_latest,
    "dense_url_ids": writes.dense_url_ids,
    "delete_app": lambda s, d: deletion.chosen(s, d, app=largest_app(s, d)),
    "delete_range": lambda s, d: deletion.chosen(s, d, start=1_610_000_000_000, end=1_610_600_000_000),
    "delete_host": lambda s, d: deletion.chosen(s, d, host="wiki.lumen.test"),
    "delete_path": lambda s, d: deletion.chosen(s, d, path_prefix="~/documents/"),
    "delete_cascade": lambda s, d: deletion.cascade(s, d, deletion.chosen(s, d, app=largest_app(s, d))),
    "quota_expiry": lambda s, d: deletion.expiry(s, d, quota(s, d)),
    "deleted_intervals": deletion.deleted_intervals,
    "reconcile": deletion.reconcile,
    "retention": lambda s, d: deletion.retained(s, d, NOW),
    "integrity": deletion.integrity,
}

GONE = "gone as (select device_id, id from obs where deleted_at is null and app_id in (select id from apps where lower(bundle_id) = (select lower(bundle_id) from apps where id = 1)))"
FREED = """
    lft as (select * from occ where (device_id, observation_id) not in (select (device_id, id) from gone)),
    freed as (select t.device_id, t.id, octet_length(encode(text)) as n from text_versions t where (device_id, id) in (select (device_id, text_version_id) from occ) and (device_id, id) not in (select (device_id, text_version_id) from lft))"""
COUNT = lambda name, sql: f"select '{name}' as what, count(*) as value from ({sql})"


def _integrity() -> str:
    gone = lambda key, name: f"select 1 from obs where {key} is not null and {key} not in (select id from {name})"
    parts = {
        "app_missing": gone("app_id", "apps"), "window_missing": gone("window_id", "windows"), "url_missing": gone("url_id", "urls"), "file_missing": gone("file_id", "files"),
        "occurrence_without_observation": "select 1 from occurrences c where not exists (select 1 from obs o where o.device_id = c.device_id and o.id = c.observation_id)",
        "occurrence_without_text": "select 1 from occurrences c where not exists (select 1 from text_versions o where o.device_id = c.device_id and o.id = c.text_version_id)",
        "occurrence_of_deleted": "select 1 from occurrences c where exists (select 1 from obs o where o.device_id = c.device_id and o.id = c.observation_id and deleted_at is not null)",
        "text_never_shown": "select 1 from text_versions t where not exists (select 1 from occurrences c where c.device_id = t.device_id and c.text_version_id = t.id)",
        "observation_twice": "select 1 from observations group by device_id, id having count(*) > 1", "occurrence_twice": "select 1 from occurrences group by device_id, id having count(*) > 1",
        "text_twice": "select 1 from text_versions group by device_id, sha256 having count(*) > 1", "byte_len_wrong": "select 1 from text_versions where byte_len <> octet_length(encode(text))",
        "hash_wrong": "select 1 from text_versions where lower(hex(sha256)) <> sha256(text)", "window_without_app": "select 1 from windows w where not exists (select 1 from apps a where a.id = w.app_id)",
        "thumb_of_deleted": "select 1 from obs where deleted_at is not null and thumb_ref is not null", "ts_missing": "select 1 from obs where ts is null",
    }
    return f"with {OBS} " + " union all ".join(COUNT(k, v) for k, v in parts.items())


SQL = {
    "apps_from_feed": "with f as (select lower(bundle_id) as k, arg_min(bundle_id, (name, bundle_id)) as bundle_id, arg_min(name, (name, bundle_id)) as name from apps where lower(name) >= 'l' and lower(bundle_id) not in (select lower(bundle_id) from apps where lower(name) < 'n') group by 1) select (select max(id) from apps where lower(name) < 'n') + row_number() over (order by k) as id, bundle_id, name from f",
    "versions_shown": f"with {OBS} select c.device_id as device, sha256(t.text) as sha256, max(octet_length(encode(t.text))) as byte_len, min(c.id) as first_id, count(*) - 1 as reused from occ c join text_versions t on t.device_id = c.device_id and t.id = c.text_version_id where text is not null group by 1, 2",
    "late_texts": f"with {OBS}, l as (select distinct device_id, observation_id from occ where text_version_id = 2) select l.device_id, l.observation_id, 1::bigint as text_version_id, max(ord) + 1 as ord from l join occ using (device_id, observation_id) group by 1, 2",
    "window_latest": f"with {OBS}, r as (select *, row_number() over (partition by device_id, app_id order by ts desc, id desc) as k from obs where deleted_at is null and app_id is not null and ts is not null) select device_id, app_id, window_id, ts from r where k = 1",
    "dense_url_ids": "select raw_locator, 1000 + row_number() over (order by raw_locator) as id from urls",
    "delete_app": f"with {OBS}, {GONE} select * from gone",
    "delete_range": f"with {OBS} select device_id, id from obs where deleted_at is null and ts >= 1610000000000 and ts < 1610600000000",
    "delete_host": f"with {OBS} select device_id, id from obs where deleted_at is null and url_id in (select id from urls where lower(host) = 'wiki.lumen.test')",
    "delete_path": f"with {OBS} select device_id, id from obs where deleted_at is null and file_id in (select id from files where starts_with(lower(path), '~/documents/'))",
    "delete_cascade": f"with {SESSIONS}, {OBS}, {GONE}, {FREED}" + """
        select 'observations' as what, count(*) as value from gone
        union all select 'occurrences', count(*) from occ where (device_id, observation_id) in (select (device_id, id) from gone)
        union all select 'versions', count(*) from freed
        union all select 'chunks', count(*) from chunks where (device_id, text_version_id) in (select (device_id, id) from freed)
        union all select 'sessions', count(*) from (select distinct n.device_id, display, app, session from n join gone on gone.device_id = n.device_id and gone.id = n.id)
        union all select 'bytes', coalesce(sum(n), 0)::bigint from freed""",
    "quota_expiry": f"""with {OBS}, sz as (select device_id, id, coalesce(octet_length(encode(text)), 0) as n from text_versions), tot as (select sum(n)::bigint as used from sz), q as (select used // 2 as quota from tot),
        o as (select *, row_number() over (order by ts, device_id, id) as k from obs where ts is not null),
        l as (select c.device_id, c.text_version_id, max(o.k) as k from occ c join o on o.device_id = c.device_id and o.id = c.observation_id group by 1, 2),
        fr as (select l.k, sum(n) as n from l join sz on sz.device_id = l.device_id and sz.id = l.text_version_id group by 1),
        cu as (select k, sum(n) over (order by k) as freed from fr)
        select used::bigint as used, case when used <= quota then 0 else ceil((select min(k) from cu where used - freed <= quota) / 200) * 200 end::bigint as expired, case when used * 10 >= 8 * quota then 'warn' else 'ok' end as level from tot, q""",
    "deleted_intervals": f"with {OBS}, d as (select distinct coalesce(origin_device, device_id) as device, coalesce(origin_id, id) as id from obs where deleted_at is not null), g as (select *, id - row_number() over (partition by device order by id) as r from d) select device, min(id) as lo, max(id) as hi from g group by device, r",
    "reconcile": " union all ".join(
        COUNT(k, v) for k, v in {
            "chunks_without_text": "select 1 from chunks c where not exists (select 1 from text_versions t where t.device_id = c.device_id and t.id = c.text_version_id)",
            "texts_without_chunks": "select 1 from text_versions t where not exists (select 1 from chunks c where c.device_id = t.device_id and c.text_version_id = t.id)",
            "embedded_without_model": "select 1 from chunks where embedded_at is not null and model is null", "pending": "select 1 from chunks where embedded_at is null",
        }.items()
    ),
    "retention": f"with {OBS} select device_id, count(*) as expired from obs where deleted_at < {NOW} - 2592000000 group by 1",
    "integrity": _integrity(),
}
