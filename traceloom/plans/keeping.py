"""Validity of caches, digests and sizes: plans and their SQL."""

from __future__ import annotations

from traceloom.operators import upkeep
from traceloom.operators.evaluation import QUERIES as ASKED
from traceloom.plans.activity import SESSIONS
from traceloom.plans.retrieval import LIVE

QUERIES = {
    "day_fingerprints": upkeep.day_fingerprints,
    "days_to_recompute": upkeep.days_to_recompute,
    "distinct_counts": upkeep.distinct_counts,
    "content_digest": upkeep.content_digest,
    "column_bytes": upkeep.column_bytes,
    "session_meta": upkeep.session_meta,
    "title_trigrams": upkeep.title_trigrams,
    "relevant_after_deletion": upkeep.relevant_after_deletion,
}

PRINTS = "select ts // 86400000 as day, count(*) as n, arg_max(id || ':' || device_id, (id, device_id)) as top from {rows} where origin_device is null and ts is not null group by 1"
HOST = "(select id from urls where lower(host) = 'wiki.lumen.test')"
SQL = {
    "day_fingerprints": f"with {LIVE} " + PRINTS.format(rows="obs"),
    "days_to_recompute": f"with {LIVE}, k as (select * from obs where url_id is null or url_id not in {HOST}), a as ({PRINTS.format(rows='obs')}), b as ({PRINTS.format(rows='k')}) select a.day, (a.day + 3) // 7 as week from a left join b using (day) where a.n is distinct from b.n or a.top is distinct from b.top",
    "distinct_counts": f"with {LIVE} select count(distinct device_id) as device_id, count(distinct app_id) as app_id, count(distinct window_id) as window_id, count(distinct url_id) as url_id, count(distinct file_id) as file_id from obs",
    "column_bytes": " union all ".join(f"select '{t}.{c}' as what, coalesce(sum(octet_length(encode({c}))), 0)::bigint as bytes from {t}" for t, c in (("text_versions", "text"), ("windows", "title"), ("urls", "raw_locator"), ("files", "path"), ("apps", "name"))),
    "session_meta": f"with {SESSIONS} select max(end_ts - start_ts) as longest_ms, max(start_ts) as last_start from sess",
    "title_trigrams": "with t as (select id, lower(title) as t from windows where title is not null), g as (select distinct id, substr(t, i, 3) as token from (select id, t, unnest(generate_series(1, greatest(length(t) - 2, 0))) as i from t)) select token, count(*) as titles from g group by 1",
    "relevant_after_deletion": f"with {LIVE}, asked(query) as (values " + ", ".join(f"('{q}')" for q in ASKED) + f"), lft as (select device_id, text_version_id from occ where (device_id, observation_id) not in (select (device_id, id) from obs where url_id in {HOST})), rel as (select query, device_id, id from text_versions, asked where contains(lower(text), query)) select query, count(*) as before, count(*) filter ((device_id, id) in (select (device_id, text_version_id) from lft)) as after from rel group by 1",
}
