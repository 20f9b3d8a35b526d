"""Queries of the library and their SQL, apart from those of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from traceloom.operators import periods, skew
from traceloom.plans import activity, keeping, learning, retrieval, services, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": skew.heavy_apps,
    "p5_activity": skew.app_activity,
    "p6_found": periods.period_bounds,
    "p6_periods": periods.device_periods,
    "p6_apps": periods.period_apps,
    **activity.QUERIES,
    **storage.QUERIES,
    **retrieval.QUERIES,
    **learning.QUERIES,
    **services.QUERIES,
    **keeping.QUERIES,
}

LIVE = "live as (select distinct * from observations where deleted_at is null and origin_device is null)"
PERIODS = f"""with {LIVE},
    marked as (select *, case when ts - lag(ts) over (partition by device_id order by ts, id) < 300000 then 0 else 1 end as begins from live where ts is not null),
    numbered as (select *, sum(begins) over (partition by device_id order by ts, id rows unbounded preceding) as period from marked),
    whole as (select device_id, period, min(ts) as start_ts, max(ts) as end_ts, count(*) as observations from numbered group by 1, 2)"""

SQL: dict[str, str] = {
    "p5_found": "select app_id from observations where app_id is not null group by app_id having count(*) * 20 >= (select count(*) from observations)",
    "p5_activity": """select o.app_id, lower(a.bundle_id) as bundle_id, count(*) as observations, min(ts) as first_ts, max(ts) as last_ts
        from observations o left join apps a on a.id = o.app_id group by 1, 2""",
    "p6_found": f"{PERIODS} select device_id, start_ts, end_ts from whole",
    "p6_periods": f"{PERIODS} select device_id, start_ts, end_ts, end_ts - start_ts as duration_ms, observations from whole",
    "p6_apps": f"{PERIODS} select n.device_id, w.start_ts, n.app_id, count(*) as observations from numbered n join whole w on w.device_id = n.device_id and w.period = n.period group by 1, 2, 3",
    **activity.SQL,
    **storage.SQL,
    **retrieval.SQL,
    **learning.SQL,
    **services.SQL,
    **keeping.SQL,
}
