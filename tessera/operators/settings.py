"""Settings laid over one another: partial updates, filters and limits, as columns.

One rule holds wherever an update may leave fields out: a field that is absent keeps what is
stored, a null clears it, a value replaces it. Whether a JSON update names a field is read from
the update itself, so null and absent stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NANOS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_DURATION = r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h))+"

#: Fields of a source's envelope, and of an issue tracker's settings.
ENVELOPE = "description string, analyze_images boolean, refresh_interval long, specs array<string>"
ENVELOPE_UPDATE = "description string, analyze_images boolean, refresh_interval string, specs array<string>"
ISSUE_CONFIG = "base_url string, user string, api_token string, project string, jql string, include_labels array<string>, exclude_labels array<string>, include_subtasks boolean, team_fields array<string>, max_issues long, full_resync_schedule string, full_resync_every string"


def named(update: Column) -> Column:
    """Names of the fields that a JSON update holds, those that are null too; no object: none."""
    return F.coalesce(F.json_object_keys(update), F.array().cast("array<string>"))


def _fields(schema: str) -> list[str]:
    return T._parse_datatype_string(schema).names


def merged(stored: Column, update: Column, present: Column, schema: str, keep_blank: tuple[str, ...] = ()) -> Column:
    """A struct of ``schema``: the update's fields where ``present`` names them, else the stored ones.

    Fields of ``keep_blank`` are secrets that are only ever written: nothing or '' keeps what is stored.
    """
    out = []
    for f in _fields(schema):
        there = F.coalesce(F.array_contains(present, f), F.lit(False))
        if f in keep_blank:
            there = there & (F.coalesce(update[f], F.lit("")) != "")
        out.append(F.when(there, update[f]).otherwise(stored[f]).alias(f))
    return F.struct(*out)


def merged_json(stored: Column, update: Column, schema: str, keep_blank: tuple[str, ...] = ()) -> Column:
    """The same of two JSON texts; what is not of the schema is left out. No stored text: an empty one."""
    return merged(F.from_json(F.coalesce(stored, F.lit("{}")), schema), F.from_json(update, schema), named(update), schema, keep_blank)


def issue_config(stored: Column, update: Column) -> Column:
    """An issue tracker's settings after an update, both JSON; a blank token keeps the stored one."""
    return merged_json(stored, update, ISSUE_CONFIG, ("api_token",))


def duration(text: Column) -> Column:
    """Nanoseconds of a duration such as ``1h30m`` or ``-1.5s``; '' and ``manual`` are 0, another text null."""
    bare = F.trim(text)
    parts = F.regexp_extract_all(bare, F.lit(r"([0-9.]+)(ns|us|µs|μs|ms|s|m|h)"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for kv in _NANOS.items() for x in kv])
    one = lambda x: (F.regexp_extract(x, r"^[0-9.]+", 0).cast("decimal(20,9)") * F.element_at(unit, F.regexp_extract(x, r"[^0-9.]+$", 0)).cast("decimal(15,0)")).cast("decimal(38,6)")
    total = F.aggregate(F.transform(parts, one), F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x).cast("decimal(38,6)"))
    sign = F.when(bare.startswith("-"), -1).otherwise(1)
    return F.when(F.coalesce(bare, F.lit("")).isin("", "manual", "0", "+0", "-0"), F.lit(0).cast("long")).when(bare.rlike(f"^{_DURATION}$"), (sign * total).cast("long"))


def collection_update(stored: Column, update: Column) -> Column:
    """A source's envelope after a JSON update; ``error`` says what could not be read, and then nothing changes.

    The description is trimmed, blank schedules are dropped, an interval is a duration.
    """
    new, present = F.from_json(update, ENVELOPE_UPDATE), named(update)
    interval = duration(new["refresh_interval"])
    specs = F.coalesce(F.filter(F.transform(new["specs"], lambda s: F.trim(s)), lambda s: s != ""), F.array().cast("array<string>"))
    clean = F.struct(
        F.coalesce(F.trim(new["description"]), F.lit("")).alias("description"), F.coalesce(new["analyze_images"], F.lit(False)).alias("analyze_images"),
        F.coalesce(interval, F.lit(0)).alias("refresh_interval"), specs.alias("specs"),
    )
    bad = F.coalesce(F.array_contains(present, "refresh_interval") & interval.isNull(), F.lit(False))
    none = F.array().cast("array<string>")
    out = merged(stored, clean, F.when(bad, none).otherwise(present), ENVELOPE)
    return F.struct(*[out[f].alias(f) for f in _fields(ENVELOPE)], F.when(bad, "refresh_interval").alias("error"))


def merged_filters(base: Column, over: Column) -> Column:
    """A repository's file filters over the common ones: its inclusion replaces, additions and exclusions add up."""
    none = F.array().cast("array<string>")
    own = lambda x: F.coalesce(x, none)
    return F.struct(
        F.when(F.size(own(over["include"])) > 0, over["include"]).otherwise(own(base["include"])).alias("include"),
        F.concat(own(base["include_extra"]), own(over["include_extra"])).alias("include_extra"),
        F.concat(own(base["exclude"]), own(over["exclude"])).alias("exclude"),
    )


def merged_limits(base: Column, over: Column, fields: tuple[str, ...]) -> Column:
    """A repository's limits over the common ones: each that is above 0 replaces."""
    return F.struct(*[F.when(over[f] > 0, over[f]).otherwise(base[f]).alias(f) for f in fields])


def merged_ignores(base: Column, extra: Column) -> Column:
    """Two lists of names to ignore as one: without blanks, slashes around them and repeats, the first ones first."""
    none = F.array().cast("array<string>")
    bare = F.transform(F.concat(F.coalesce(base, none), F.coalesce(extra, none)), lambda x: F.regexp_replace(F.trim(x), "^/+|/+$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))
