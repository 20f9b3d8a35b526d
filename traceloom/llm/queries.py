"""Queries of the problems on texts, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.llm import mojibake, packing, personal, runs, scans, splitting, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": personal.p1_found,
    "p1_redacted": personal.p1_redacted,
    "p2_found": runs.p2_found,
    "p2_runs": runs.p2_runs,
    "p3_found": scans.p3_found,
    "p3_paragraphs": scans.p3_paragraphs,
    "p4_found": splitting.p4_found,
    "p4_pieces": splitting.p4_pieces,
    "p7_ids": tokens.p7_ids,
    "p7_decoded": tokens.p7_decoded,
    "p8_containers": packing.p8_containers,
    "p8_fill": packing.p8_fill,
    "p9_found": mojibake.p9_found,
    "p9_repaired": mojibake.p9_repaired,
}

SQL: dict[str, str] = {
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p4_found": """
        with lim as (select capacity, overlap from size_limits where name = 'piece'),
        t as (select vrow, device_id, id, coalesce(encode(text), ''::blob) as b, octet_length(coalesce(encode(text), ''::blob)) as size from text_versions),
        c as (select *, "offset" + len as stop, lag("offset") over w as lat, lag("offset" + len) over w as lend,
                row_number() over w as k, (lead(1) over w) is null as is_last
            from chunks window w as (partition by device_id, text_version_id order by ord, "offset", "offset" + len)),
        j as (select t.*, c."offset" as "at", c.stop, c.lat, c.lend, c.k, c.is_last, lim.capacity, lim.overlap
            from t cross join lim left join c on c.device_id = t.device_id and c.text_version_id = t.id)
        select distinct vrow from j where case
            when k is null then size > capacity
            else "at" is null or stop is null or "at" < 0 or stop < "at" or stop - "at" > capacity or stop > size or (k = 1 and "at" <> 0)
                or (is_last and stop <> size)
                or ("at" < size and substr(hex(b), (2 * "at" + 1)::int, 1) in ('8', '9', 'A', 'B'))
                or (stop < size and substr(hex(b), (2 * stop + 1)::int, 1) in ('8', '9', 'A', 'B'))
                or (k > 1 and coalesce(least(stop, lend) - greatest("at", lat) < overlap, true)) end""",
}
