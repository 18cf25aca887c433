"""Incremental synchronisation: change detection, upserts, pruning, repair, watermarks, schedules."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import content_hash

OVERLAP = timedelta(minutes=1)


def changed(new: DataFrame, stored: DataFrame, key: list[str], text: str, hash_: str = "hash") -> DataFrame:
    """Rows whose content hash differs from the stored one, or which are not stored; adds ``hash`` and ``change``."""
    own = new.withColumn("_h", content_hash(F.coalesce(F.col(text), F.lit(""))))
    both = own.join(stored.select(*key, F.col(hash_).alias("_old")), key, "left")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_old") != F.col("_h"), "updated").otherwise("unchanged")
    return both.select(*new.columns, F.col("_h").alias("hash"), kind.alias("change"))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without those that are replaced, and the new ones."""
    return stored.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows.select(stored.columns))


def prune(existing: DataFrame, seen: DataFrame, removed: DataFrame, key: list[str], complete: bool) -> DataFrame:
    """Keys to delete: removed and not seen again; after a complete sweep also whatever was not seen."""
    gone = removed.select(*key).join(seen, key, "left_anti")
    if complete:
        gone = gone.unionByName(existing.select(*key).join(seen, key, "left_anti"))
    return existing.select(*key).join(gone.distinct(), key, "left_semi").distinct()


def missing_from_indexes(candidates: DataFrame, indexes: list[DataFrame], queued: DataFrame, key: list[str]) -> DataFrame:
    """Candidates that some index lacks and that are not queued yet."""
    whole = indexes[0].select(*key)
    for i in indexes[1:]:
        whole = whole.intersect(i.select(*key))
    return candidates.join(whole, key, "left_anti").join(queued, key, "left_anti")


def since(rows: DataFrame, updated: str, watermark: Column | None) -> DataFrame:
    """Rows at or after the watermark; without one, all."""
    return rows if watermark is None else rows.where(F.col(updated) >= watermark)


def next_watermark(rows: DataFrame, updated: str) -> DataFrame:
    """The latest update less a minute, to the minute; of all rows read, before any filter. Nothing read: null."""
    return rows.agg(F.date_trunc("minute", F.max(updated) - F.expr("INTERVAL 1 MINUTE")).alias("watermark"))


def signature(parts: list[str]) -> str:
    """Sixteen hex digits that change when a source's filters do."""
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def bounded_query(query: str, watermark: datetime | None) -> str:
    """An issue query in update order, from the watermark on; its own order is taken off."""
    at = query.upper().rfind("ORDER BY")
    base = (query[:at] if at >= 0 else query).strip()
    if watermark is not None:
        since_ = f'updated >= "{watermark:%Y-%m-%d %H:%M}"'
        base = f"({base}) AND {since_}" if base else since_
    return f"{base} ORDER BY updated ASC".strip()


def wiki_query(space: str = "", ancestor: str = "", watermark: datetime | None = None) -> str:
    parts = ["type = page"]
    if space:
        parts.append(f'space = "{space}"')
    if ancestor:
        parts.append(f"ancestor = {ancestor}")
    if watermark is not None:
        parts.append(f'lastmodified >= "{watermark:%Y-%m-%d %H:%M}"')
    return " AND ".join(parts) + " ORDER BY lastmodified ASC"


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else ((int(span), high if step else int(span)) if "-" not in span else tuple(map(int, span.split("-"))))
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def next_tick(spec: str, after: datetime) -> datetime:
    """First time after ``after`` of a five-field cron schedule, or of ``@every 1h30m``."""
    if spec.startswith("@every "):
        import re

        unit = {"h": 3600, "m": 60, "s": 1}
        return after + timedelta(seconds=sum(int(n) * unit[u] for n, u in re.findall(r"(\d+)([hms])", spec[7:])))
    spec = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *"}.get(spec, spec)
    minute, hour, day, month, week = spec.split()
    m, h, d, mo, w = _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12), {x % 7 for x in _field(week, 0, 7)}
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 24 * 60 * 5):
        by_day, by_week = t.day in d, (t.isoweekday() % 7) in w
        # a restricted day of month or of week is enough if both are
        day_ok = (by_day or by_week) if day != "*" and week != "*" else by_day and by_week
        if t.month not in mo or not day_ok:
            t = t.replace(hour=0, minute=0) + timedelta(days=1)
        elif t.hour not in h:
            t = t.replace(minute=0) + timedelta(hours=1)
        elif t.minute not in m:
            t += timedelta(minutes=1)
        else:
            return t
    raise ValueError(f"{spec} never comes")


def full_sweep_due(last_full: datetime | None, now: datetime, signature_changed: bool, spec: str = "0 2 * * *") -> bool:
    return signature_changed or last_full is None or next_tick(spec, last_full) <= now
