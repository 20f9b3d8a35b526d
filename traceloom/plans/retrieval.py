"""Search, evidence and text functions: plans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.operators import evidence, search
from traceloom.store import table

Q = "query planner"
LO, HI = 1_610_000_000_000, 1_610_600_000_000


def asked(spark, sf_dir):
    """The asked rows of the evidence queries: the first of each device, and one that is nowhere."""
    rows = table(spark, sf_dir, "observations").groupBy("device_id").agg(F.min("id").alias("id"))
    return rows.unionByName(spark.createDataFrame([("nowhere", 1)], "device_id string, id long"))


def docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *cols)



QUERIES = {
    "search_title": lambda s, d: search.by_object(s, d, "title", Q),
    "search_host": lambda s, d: search.by_object(s, d, "host", "lumen.test"),
    "search_url": lambda s, d: search.by_object(s, d, "url", "docs.northpeak.example/search", None),
    "search_path": lambda s, d: search.by_object(s, d, "path", "documents", None),
    "search_app": lambda s, d: search.by_object(s, d, "app", "tide", None),
    "search_index": lambda s, d: search.by_index(s, d, Q),
    "search_index_whole": lambda s, d: search.by_index(s, d, Q, None, None),
    "search_index_texts": lambda s, d: search.index_hits(s, d, "预算表", None),
    "search_range": lambda s, d: search.by_index(s, d, Q, 50, start=LO, end=HI),
    "search_scan": lambda s, d: search.by_scan(s, d, "%"),
    "search_union": lambda s, d: search.union(search.channels_of(s, d, Q)),
    "search_fused": lambda s, d: search.fused(search.channels_of(s, d, Q)),
    "search_summaries": lambda s, d: search.summaries(s, d, search.union(search.channels_of(s, d, Q)), Q),
    "search_bm25": lambda s, d: search.bm25(s, d, ["budget", "memory"]),
    "term_counts": search.term_counts,
    "evidence": lambda s, d: evidence.evidence(s, d, asked(s, d)),
    "evidence_masked": lambda s, d: evidence.evidence(s, d, asked(s, d), None, "summary"),
    "evidence_texts": evidence.texts_of,
    "neighbours": lambda s, d: evidence.neighbours(s, d, asked(s, d)),
    "item_app": lambda s, d: evidence.item(s, d, "app_id", 1),
    "item_days": lambda s, d: evidence.item_days(s, d, "app_id", 1),
    "item_titles": lambda s, d: evidence.item_titles(s, d, "app_id", 1),
    "url_dwell": lambda s, d: evidence.object_dwell(s, d, "url_id"),
    "app_stats": evidence.app_stats,
    "capture_methods": evidence.capture_methods,
    "store_stats": evidence.store_stats,
    "context": lambda s, d: evidence.context_lines(s, d, LO, HI),
    "token_estimates": lambda s, d: docs(s, d, T.tokens_estimate(F.col("text")).alias("tokens")),
    "truncated_texts": lambda s, d: docs(s, d, T.truncated(F.col("text"), 20).alias("text")),
    "narrative_tokens": lambda s, d: docs(s, d, T.narrative_tokens(F.col("text")).alias("tokens")),
    "snippets": lambda s, d: docs(s, d, T.snippet(F.col("text"), Q).alias("snippet")),
    "bigrams": lambda s, d: docs(s, d, T.bigrams("text").alias("text")),
    "folded": lambda s, d: docs(s, d, T.fold("text").alias("text")),
    "luhn_titles": lambda s, d: table(s, d, "windows").select("id", F.coalesce(T.luhn(F.col("title")), F.lit(False)).alias("luhn")),
    "redacted_secrets": lambda s, d: docs(s, d, T.redact_secrets("text").alias("r")).select("doc_id", "r.text", "r.found"),
    "coverage": lambda s, d: docs(s, d, T.coverage(F.col("title"), F.col("text")).alias("share")).withColumn("share", F.round("share", 6)),
    "opaque_tokens": evidence.opaque_share,
    "number_literals": lambda s, d: docs(s, d, F.size(T.number_literals(F.col("text"))).alias("numbers")),
    "slugs": lambda s, d: table(s, d, "windows").select("id", T.slug(F.col("title")).alias("slug")),
    "routes": lambda s, d: table(s, d, "urls").select("id", T.route(F.col("raw_locator")).alias("route")),
    "hosts": lambda s, d: table(s, d, "urls").select("id", T.bare_host(F.col("raw_locator")).alias("host"), T.has_path(F.col("raw_locator")).alias("has_path"), T.url_kind(F.col("raw_locator")).alias("kind")),
    "file_paths": lambda s, d: table(s, d, "urls").select("id", T.file_path(F.col("raw_locator")).alias("path")),
    "private_titles": lambda s, d: table(s, d, "windows").where(T.private_title(F.col("title"))).select("id"),
}

LIVE = "obs as (select distinct * from observations where deleted_at is null), occ as (select distinct * from occurrences)"
TOP = "order by ts desc, device_id desc, id desc limit 50"
HIT = f"th as (select vrow, device_id, id from text_versions where contains(lower(text), '{Q}') order by vrow desc limit 200)"
SHOWN = "(device_id, id) in (select (occ.device_id, occ.observation_id) from occ join th on th.device_id = occ.device_id and th.id = occ.text_version_id)"
TITLE = f"ti as (select device_id, id, ts from obs where window_id in (select id from windows where contains(lower(title), '{Q}')) {TOP})"
CHANNELS = f"{LIVE}, {HIT}, {TITLE}, ix as (select device_id, id, ts from obs where {SHOWN} {TOP}), ch as (select 0 as turn, 'exact' as channel, *, row_number() over (order by ts desc, device_id desc, id desc) as rank from ti union all select 1, 'index', *, row_number() over (order by ts desc, device_id desc, id desc) from ix)"
ASKED = "asked as (select device_id, min(id) as id from observations group by 1 union all select 'nowhere', 1)"
EVTEXT = "tx as (select occ.device_id, observation_id as id, string_agg(text, chr(10) order by ord, occ.id) as text from occ join text_versions t on t.device_id = occ.device_id and t.id = occ.text_version_id group by 1, 2)"
FLAT = "replace(replace(replace(text, chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' ')"

SQL = {
    "search_title": f"with {LIVE}, {TITLE} select * from ti",
    "search_host": f"with {LIVE} select device_id, id, ts from obs where url_id in (select id from urls where lower(host) = 'lumen.test' or suffix(lower(host), '.lumen.test') or contains(lower(canonical_url), 'lumen.test') or contains(lower(raw_locator), 'lumen.test')) {TOP}",
    "search_url": f"with {LIVE} select device_id, id, ts from obs where url_id in (select id from urls where contains(lower(canonical_url), 'docs.northpeak.example/search') or contains(lower(raw_locator), 'docs.northpeak.example/search'))",
    "search_path": f"with {LIVE} select device_id, id, ts from obs where file_id in (select id from files where contains(lower(path), 'documents'))",
    "search_app": f"with {LIVE} select device_id, id, ts from obs where app_id in (select id from apps where contains(lower(bundle_id), 'tide') or contains(lower(name), 'tide'))",
    "search_index": f"with {LIVE}, {HIT} select device_id, id, ts from obs where {SHOWN} {TOP}",
    "search_index_whole": f"with {LIVE}, {HIT.replace(' order by vrow desc limit 200', '')} select device_id, id, ts from obs where {SHOWN}",
    "search_index_texts": "select vrow, device_id, id from text_versions where contains(text, '预算表')",
    "search_range": f"with {LIVE}, {HIT.replace('limit 200', 'limit 2000')} select device_id, id, ts from obs where ts >= {LO} and ts < {HI} and {SHOWN} {TOP}",
    "search_scan": f"with {LIVE}, th as (select device_id, id from text_versions where contains(text, '%') or contains(text, '％') or contains(text, '﹪')) select device_id, id, ts from obs where ts >= (select max(ts) from obs) - 7 * 86400000 and {SHOWN} {TOP}",
    "search_union": f"with {CHANNELS}, f as (select *, row_number() over (partition by device_id, id order by turn, rank) as k from ch) select device_id, id, channel, ts from f where k = 1 order by turn, rank limit 50",
    "search_fused": f"with {CHANNELS}, f as (select device_id, id, sum(1.0::double / (60 + rank)) as score, min((turn, rank, channel)) as r from ch group by 1, 2) select device_id, id, case when r[1] = 0 then 'exact' else 'index' end as channel, round(score, 9) as score from f order by round(score, 12) desc, r[1], r[2] limit 50".replace("r[1]", "struct_extract_at(r, 1)").replace("r[2]", "struct_extract_at(r, 2)"),
    "evidence": f"with {LIVE}, {ASKED}, {EVTEXT} select a.device_id, a.id, case when o.ts is null then 'missing' else 'ok' end as status, case when o.ts is not null then text end as text, false as redacted from asked a left join obs o using (device_id, id) left join tx using (device_id, id)",
    "evidence_masked": f"with {LIVE}, {ASKED} select a.device_id, a.id, case when o.ts is null then 'missing' else 'ok' end as status, null::varchar as text, o.ts is not null as redacted from asked a left join obs o using (device_id, id)",
    "evidence_texts": f"with {LIVE}, {EVTEXT} select * from tx",
    "neighbours": f"with {LIVE}, {ASKED}, a as (select o.device_id, coalesce(display_id, -1) as display, o.id as f, ts as t from obs o join asked using (device_id, id)), n as (select o.device_id, a.f, case when ts < t then 'before' else 'after' end as side, o.id, row_number() over (partition by o.device_id, a.f, ts < t order by abs(ts - t), case when ts < t then -o.id else o.id end) as k from obs o join a on a.device_id = o.device_id and a.display = coalesce(o.display_id, -1) and ts <> t) select device_id, f as \"of\", side, k, id from n where k <= 2",
    "item_app": f"with {LIVE} select count(*) as observations, min(ts) as first_ts, max(ts) as last_ts, count(distinct ts // 86400000) as days, count(distinct app_id) as apps from obs where app_id = 1",
    "item_days": f"with {LIVE} select ts // 86400000 as day, count(*) as observations from obs where app_id = 1 and ts is not null group by 1",
    "item_titles": f"with {LIVE} select title, count(*) as observations from obs join windows w on w.id = obs.window_id where obs.app_id = 1 group by 1 order by 2 desc, 1 limit 10",
    "url_dwell": f"with {LIVE}, g as (select url_id, least(ts - lag(ts) over (partition by url_id, device_id, coalesce(display_id, -1), ts // 86400000 order by ts, id), 90000) as gap from obs where url_id is not null and ts is not null) select url_id, coalesce(sum(gap), 0) as dwell_ms, count(*) as observations from g group by 1",
    "app_stats": f"with {LIVE}, r as (select app_id, count(*) as observations, count(*) filter (completeness = 'complete') as complete, count(*) filter (completeness = 'partial') as partial, count(*) filter (completeness = 'unavailable') as unavailable, count(*) filter (source_state <> 'ok') as not_ok, min(ts) as first_ts, max(ts) as last_ts from obs group by 1) select r.*, bundle_id, name from r left join apps on apps.id = r.app_id",
    "capture_methods": f"with {LIVE} select app_id, capture_method, count(*) as texts, round(avg(confidence), 6) as confidence from obs join occ on occ.device_id = obs.device_id and occ.observation_id = obs.id group by 1, 2",
    "store_stats": "with o as (select distinct * from observations), c as (select distinct * from occurrences), x as (select (select count(*) from o) as observations, (select count(origin_device) from o) as imported, (select count(deleted_at) from o) as deleted, (select count(*) from text_versions) as texts, (select sum(octet_length(encode(text)))::bigint from text_versions) as bytes, (select count(*) from c) as shown) select *, round(1 - texts / nullif(shown, 0), 6) as repeat_rate from x",
    "token_estimates": "select doc_id, ceil(length(text) / 2)::bigint as tokens from documents where text is not null",
    "truncated_texts": "select doc_id, case when length(text) > 40 then substr(text, 1, 39) || '…' else text end as text from documents where text is not null",
    "narrative_tokens": r"select doc_id, (ceil(length(text) - h - w + h / 2 + w / 3 - 1e-9) + 48)::bigint as tokens from (select doc_id, text, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as h, length(regexp_replace(text, '[^ \t\n\x0B\f\r]', '', 'g')) as w from documents where text is not null)",
    "snippets": f"with f as (select doc_id, {FLAT} as t from documents where text is not null), a as (select *, position('{Q}' in lower(t)) as at, length(t) as n from f), b as (select *, greatest(1, at - 40) as lo, least(n, at + {len(Q) - 1} + 40) as hi from a) select doc_id, case when at > 0 then case when lo > 1 then '…' else '' end || substr(t, lo, hi - lo + 1) || case when hi < n then '…' else '' end else substr(t, 1, 80) end as snippet from b".replace(" as at,", ' as "at",').replace(" at ", ' "at" ').replace(", at ", ', "at" '),
    "coverage": r"with w as (select doc_id, lower(text) as t, list_filter(list_distinct(regexp_split_to_array(lower(title), '[^\p{L}\p{N}\p{M}]+')), lambda x: x <> '') as w from documents where text is not null) select doc_id, round(case when len(w) > 0 then len(list_filter(w, lambda x: contains(t, x))) / len(w) end, 6) as share from w",
    "opaque_tokens": r"select vrow, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: regexp_full_match(w, '0[xX][0-9a-fA-F]+') or (regexp_full_match(w, '[0-9a-fA-F]{7,40}') and regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-fA-F]')) or (regexp_full_match(w, '[A-Za-z0-9_-]{16,}') and regexp_matches(w, '[0-9]')))) as opaque from text_versions where text is not null",
    "number_literals": r"select doc_id, len(regexp_extract_all(text, '[0-9]+(?:[,.][0-9]+)*')) as numbers from documents where text is not null",
    "slugs": r"select id, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from windows",
    "routes": "select id, case when regexp_matches(q, '[ \\t\\n\\x0B\\f\\r]') then 'text' when regexp_matches(q, '^(https?|file)://') then 'url' when regexp_matches(q, '^(/|~/|\\./)') then 'path' when regexp_matches(q, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9-]+)*\\.[a-z]{2,}(:[0-9]+)?(/.*)?$') then 'url' when contains(q, '/') then 'path' else 'text' end as route from (select id, lower(trim(raw_locator)) as q from urls)",
    "hosts": "select id, lower(regexp_extract(raw_locator, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)) as host, contains(regexp_replace(raw_locator, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/') as has_path, case when regexp_matches(lower(raw_locator), '^https?://') then 'web' when regexp_matches(lower(raw_locator), '^file:') then 'file' when regexp_matches(lower(raw_locator), '^[a-z][a-z0-9+.-]*://') then 'deeplink' else 'other' end as kind from urls",
    "file_paths": "select id, case when regexp_matches(lower(raw_locator), '^file://') then url_decode(regexp_replace(raw_locator, '(?i)^file://(localhost)?', '')) when raw_locator like '/%' then raw_locator end as path from urls",
    "private_titles": "select id from windows where regexp_matches(lower(title), '(incognito|inprivate|private browsing|privates fenster|navigation privée|无痕|隐私浏览)')",
}
