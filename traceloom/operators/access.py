"""Grants, masking, policies and the read-only tools (SEC-1 to SEC-5, TOOL-1 to TOOL-12, STR-4 to STR-8, FLT-10)."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from traceloom.functions import dates, text as T
from traceloom.operators import evidence, ledger, patterns, search, streams
from traceloom.operators.slices import DISPLAY
from traceloom.store import once, table

#: What a tool gives at most.
CAPS = {"evidence": 50, "search": 100, "context_tokens": 20_000, "buckets": 2000, "days": 180, "items": 200, "overfetch": 5, "overfetch_most": 500}
DEFAULTS = {"get_context": "24h", "get_timeline": "today", "get_day_ledger": "today", "get_week_ledger": "this_week", "get_patterns": "today", "list_activity": "today", "recent_activity": "30m"}


@dataclass(frozen=True)
class Grant:
    """What a client may read: apps (`*` for all), how many days back, and the level (summary or evidence)."""

    client: str
    apps: tuple[str, ...] = ("*",)
    days: int = 30
    level: str = "evidence"

    def allows(self, bundle: Column) -> Column:
        """FLT-10: without case; rows without an app only if all apps are allowed."""
        if "*" in self.apps:
            return F.lit(True)
        return F.coalesce(F.lower(bundle).isin([a.lower() for a in self.apps]), F.lit(False))

    def floor(self, now: int) -> int:
        return now - self.days * 86_400_000


def scoped(spark: SparkSession, sf_dir: str, grant: Grant | None, now: int) -> DataFrame:
    """SEC-1: live rows that a grant allows; none without a grant."""
    rows = search.live_rows(spark, sf_dir)
    if grant is None:
        return rows.limit(0)
    names = table(spark, sf_dir, "apps").select(F.col("id").alias("app_id"), F.lower("bundle_id").alias("bundle_id"))
    rows = rows.join(names, "app_id", "left").where(grant.allows(F.col("bundle_id")))
    return rows.where((F.col("ts") >= grant.floor(now)) & (F.col("ts") <= now))


def masked(spark: SparkSession, sf_dir: str, grant: Grant, now: int) -> DataFrame:
    """SEC-3: rows with their text, which a grant of level summary doesn't show."""
    rows = scoped(spark, sf_dir, grant, now).select("device_id", "id", "ts", "app_id")
    texts = evidence.texts_of(spark, sf_dir)
    rows = rows.join(texts, ["device_id", "id"], "left")
    return rows.withColumn("text", F.col("text") if grant.level == "evidence" else F.lit(None).cast("string"))


def day_apps(spark: SparkSession, sf_dir: str, grant: Grant) -> DataFrame:
    """SEC-2: the day ledger of the allowed apps, and the totals worked out from them anew."""
    names = table(spark, sf_dir, "apps").select(F.col("id").alias("app"), F.lower("bundle_id").alias("bundle_id"))
    rows = ledger.day_ledger(spark, sf_dir).join(names, "app", "left").where(grant.allows(F.col("bundle_id")))
    sums = [F.sum(c).alias(c) for c in ("dwell_ms", "active_ms", "unknown_ms", "observations", "switches")]
    return rows.groupBy("day").agg(F.count("*").alias("apps"), *sums)


def audit_shape(value: str) -> str:
    """SEC-5: what the audit keeps of a parameter: its length and eight hex digits of its hash."""
    return f"{len(value)}:{hashlib.sha256(value.encode()).hexdigest()[:8]}"


@dataclass
class Tools:
    """TOOL-1 to TOOL-12: the read-only tools over a store, under a grant. Every call is audited without content."""

    spark: SparkSession
    sf_dir: str
    grant: Grant | None
    now: int
    audit: list[tuple[str, str]] = field(default_factory=list)

    def _note(self, tool: str, **params) -> None:
        if self.grant is None:
            raise PermissionError("no grant")
        self.audit.append((tool, ",".join(f"{k}={audit_shape(str(v))}" for k, v in sorted(params.items()))))

    def _bounds(self, tool: str, start=None, end=None, period: str | None = None) -> tuple[int, int, bool]:
        lo, hi, cut = dates.scope(self.now, start, end, period, DEFAULTS.get(tool, f"{self.grant.days}d"), self.grant.floor(self.now))
        if hi - lo > CAPS["days"] * 86_400_000:
            raise ValueError(f"at most {CAPS['days']} days")
        return lo, hi, cut

    def _allowed(self, rows: DataFrame) -> DataFrame:
        return rows.join(scoped(self.spark, self.sf_dir, self.grant, self.now).select("device_id", "id"), ["device_id", "id"], "left_semi")

    def search(self, query: str, limit: int = 20, start=None, end=None, period: str | None = None) -> DataFrame:
        self._note("search", query=query)
        lo, hi, _ = self._bounds("search", start, end, period)
        limit = min(limit, CAPS["search"])
        wide = limit if "*" in self.grant.apps else min(limit * CAPS["overfetch"], CAPS["overfetch_most"])
        hits = search.fused(search.channels_of(self.spark, self.sf_dir, query, wide, start=lo, end=hi), wide)
        return search.summaries(self.spark, self.sf_dir, self._allowed(hits).limit(limit), query)

    def get_evidence(self, ids: list[tuple[str, int]]) -> DataFrame:
        self._note("get_evidence", ids=ids)
        if len(ids) > CAPS["evidence"]:
            raise ValueError(f"at most {CAPS['evidence']} ids")
        rows = self.spark.createDataFrame(ids, "device_id string, id long")
        return evidence.evidence(self.spark, self.sf_dir, rows, list(self.grant.apps), self.grant.level)

    def get_context(self, tokens: int = 2000, start=None, end=None, period: str | None = None) -> list[str]:
        self._note("get_context", tokens=tokens)
        lo, hi, _ = self._bounds("get_context", start, end, period)
        return evidence.context(self.spark, self.sf_dir, lo, hi, min(tokens, CAPS["context_tokens"]))

    def get_timeline(self, size: str = "hour", start=None, end=None, period: str | None = None) -> DataFrame:
        self._note("get_timeline", size=size)
        lo, hi, _ = self._bounds("get_timeline", start, end, period)
        ms = {"hour": ledger.HOUR, "day": ledger.DAY}[size]
        if (hi - lo) // ms > CAPS["buckets"]:
            raise ValueError(f"at most {CAPS['buckets']} buckets")
        return ledger.timeline(self.spark, self.sf_dir, ms).where((F.col("start_ts") >= lo) & (F.col("start_ts") < hi))

    def get_day_ledger(self, day: int) -> DataFrame:
        self._note("get_day_ledger", day=day)
        names = table(self.spark, self.sf_dir, "apps").select(F.col("id").alias("app"), "bundle_id")
        rows = ledger.day_ledger(self.spark, self.sf_dir).where(F.col("day") == day).join(names, "app", "left")
        return rows.where(self.grant.allows(F.col("bundle_id")))

    def get_week_ledger(self, week: int) -> DataFrame:
        self._note("get_week_ledger", week=week)
        return ledger.week_ledger(self.spark, self.sf_dir).where(F.col("week") == week)

    def get_item(self, key: str, value: int) -> DataFrame:
        self._note("get_item", key=key)
        return evidence.item(self.spark, self.sf_dir, key, value)

    def get_patterns(self) -> dict[str, DataFrame]:
        self._note("get_patterns")
        of = {"heat": patterns.heat_map, "peak": patterns.peak_cell, "apps": patterns.app_patterns, "changes": patterns.transitions, "focus": patterns.focus_blocks, "sessions": patterns.session_stats}
        return {k: f(self.spark, self.sf_dir) for k, f in of.items()}

    def list_activity(self, before=None, limit: int = 50) -> DataFrame:
        self._note("list_activity", limit=limit)
        return self._allowed(patterns.activity_page(self.spark, self.sf_dir, before, min(limit, CAPS["items"])))

    def recent_activity(self, minutes: int = 30) -> DataFrame:
        self._note("recent_activity", minutes=minutes)
        return patterns.recent_activity(self.spark, self.sf_dir, minutes)


def policies(stored: DataFrame, denied: list[str], apps: DataFrame, default: str = "full") -> DataFrame:
    """STR-6, STR-7, JN-11: the policy of each app known anywhere: stored, else denied, else the default."""
    rows = apps.select(F.lower("bundle_id").alias("bundle_id"), "name").join(stored.select(F.lower("bundle_id").alias("bundle_id"), "mode"), "bundle_id", "full_outer")
    mode = F.coalesce("mode", F.when(F.col("bundle_id").isin([d.lower() for d in denied]), "off").otherwise(default))
    source = F.when(F.col("mode").isNotNull(), "stored").when(F.col("bundle_id").isin([d.lower() for d in denied]), "denied").otherwise("default")
    return rows.groupBy("bundle_id").agg(F.min("name").alias("name"), F.min(mode).alias("policy"), F.max(source).alias("source"))


def app_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies of all apps, where those whose name begins with Tide are stored as summary."""
    apps = table(spark, sf_dir, "apps")
    stored = apps.where("startswith(name, 'Tide')").select("bundle_id", F.lit("summary").alias("mode"))
    return policies(stored, ["com.unknown"], apps)


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8: class of each row by whether it has text, a window and a state that allows reading."""
    rows = search.live_rows(spark, sf_dir)
    shown = table(spark, sf_dir, "occurrences").select("device_id", F.col("observation_id").alias("id")).distinct().withColumn("has", F.lit(True))
    rows = rows.join(shown, ["device_id", "id"], "left")
    cls = F.when(F.col("source_state") != "ok", "state").when(F.col("has"), F.when(F.col("window_id").isNull(), "text").otherwise("whole")).otherwise("empty")
    return rows.groupBy(cls.alias("class"), "completeness").agg(F.count("*").alias("observations"))


def audited(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    """STR-4: every fiftieth row with text of each device and display."""
    rows = once(table(spark, sf_dir, "observations").where("deleted_at is null and ts is not null and completeness <> 'unavailable'"))
    rows = rows.select("device_id", F.coalesce("display_id", F.lit(-1)).alias("display"), "id", "ts")
    rows = streams.position(streams.blocked(rows), DISPLAY, "k")
    return rows.where(F.col("k") % every == 0).select("device_id", "display", "id")


def frame_gate(spark: SparkSession, sf_dir: str, near: int = 6) -> DataFrame:
    """MTH-2, MTH-3: frames that differ from the frame before of the same window in at most `near` bits."""
    rows = once(table(spark, sf_dir, "observations").where("deleted_at is null and ts is not null and frame_hash is not null"))
    rows = rows.select("device_id", "window_id", "id", "ts", "frame_hash")
    rows = streams.lag(streams.blocked(rows), ["device_id", "window_id"], ["frame_hash"], "before")
    half = lambda c, a: F.conv(F.substring(c, a, 8), 16, 10).cast("long")
    bits = F.bit_count(half(F.col("frame_hash"), 1).bitwiseXOR(half(F.col("before.frame_hash"), 1))) + F.bit_count(half(F.col("frame_hash"), 9).bitwiseXOR(half(F.col("before.frame_hash"), 9)))
    return rows.where(F.col("before").isNotNull()).withColumn("bits", bits).where(F.col("bits") <= near).select("device_id", "window_id", "id", "bits")


def hit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-2, SNK-4: rows as JSON, as a tool returns them."""
    rows = search.live_rows(spark, sf_dir).select("device_id", "id", F.to_json(F.struct("device_id", "id", "ts", "trigger")).alias("json"))
    return rows


def narrative_sessions(spark: SparkSession, sf_dir: str, top: int = 5) -> DataFrame:
    """NAR-1: of each day the sessions of most dwell, in order of time, with a line for the prompt."""
    from pyspark.sql import Window

    from traceloom.operators.slices import sessions

    rows = sessions(spark, sf_dir).withColumn("day", ledger.day_of(F.col("start_ts")))
    best = Window.partitionBy("day").orderBy(F.desc("dwell_ms"), "start_ts", "device_id", "display", "app")
    rows = rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)
    order = F.row_number().over(Window.partitionBy("day").orderBy("start_ts", "device_id", "display", "app"))
    return rows.select("day", order.alias("n"), "device_id", "app", "start_ts", "dwell_ms", T.duration_text(F.col("dwell_ms")).alias("length"))


def unfaithful_numbers(written: Column, known: Column) -> Column:
    """NAR-3: numbers of a narrative that its source doesn't have."""
    return F.array_except(T.number_literals(written), T.number_literals(known))


def narrative_backlog(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """NAR-4: the last finished days, which have no narrative yet."""
    rows = ledger.day_totals(spark, sf_dir).select("day")
    last = rows.agg(F.max("day").alias("last"))
    return rows.join(F.broadcast(last)).where((F.col("day") < F.col("last")) & (F.col("day") >= F.col("last") - days)).select("day")
