"""Column functions over text, names and URLs. All but ``strip_marks`` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.batches import small_batches

#: A token: letters and digits, joined by the characters that hold identifiers together.
TOKEN = r"[\p{L}\p{N}]+(?:[._\-/+@][\p{L}\p{N}]+)*"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """ASCII word runs of the lower-cased text without combining marks, as labels are searched."""
    small_batches(SparkSession.active())
    return F.regexp_extract_all(F.lower(strip_marks(text)), F.lit(r"\w+"), F.lit(0))


@F.pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without nonspacing marks."""

    def one(x):
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")

    return s.map(one)


def content_hash(x: Column) -> Column:
    """First 16 bytes of SHA-256, in hex."""
    return F.left(F.sha2(x.cast("binary"), 256), F.lit(32))


def slugify(x: Column, limit: int = 80) -> Column:
    """Runs of [a-z0-9] joined by '-', at most ``limit`` characters; nothing left: 'page'."""
    dashed = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.left(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(limit)), "-+$", "")
    return F.when(cut == "", F.lit("page")).otherwise(cut)


def url_slug(url: Column) -> Column:
    """Slug of host and path, and a hash of the whole URL."""
    host_path = F.concat(F.coalesce(F.parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")))
    return F.concat(slugify(host_path), F.lit("-"), F.left(F.sha2(url.cast("binary"), 256), F.lit(16)))


def same_origin(a: Column, b: Column) -> Column:
    """Equal scheme and host:port, whatever the case."""
    part = lambda u, p: F.lower(F.parse_url(u, F.lit(p)))
    return F.coalesce((part(a, "PROTOCOL") == part(b, "PROTOCOL")) & (part(a, "AUTHORITY") == part(b, "AUTHORITY")), F.lit(False))


def http_url_ok(u: Column) -> Column:
    """Absolute http(s) without user info, of at most 8192 characters."""
    return F.coalesce(u.rlike(r"(?i)^https?://[^/?#@\s]+([/?#]|$)") & (F.length(u) <= 8192), F.lit(False))


def repo_id(url: Column) -> Column:
    """host/path of an https, ssh or scp-style address, without user, port and .git."""
    scp = F.regexp_replace(F.trim(url), r"^(?:[^@/\s]+@)?([^:/\s]+):(?!//)(?=[^0-9]|[0-9]+[^/0-9])", "$1/")
    bare = F.regexp_replace(scp, r"^(?i)[a-z+]+://", "")
    bare = F.regexp_replace(bare, r"^[^@/]+@", "")
    bare = F.regexp_replace(bare, r"^([^/:]+):\d+/", "$1/")
    return F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"\.git$", "")


def first_repo_id(urls: list[Column], path: Column, full_name: Column) -> Column:
    """The repository that a push event names: the first address that holds a host and a path, else the path, else the full name."""
    ids = [F.when(repo_id(u).rlike(r"^[^/\s]+/[^\s]*[^/\s]$"), repo_id(u)) for u in urls]
    return F.coalesce(*ids, F.nullif(path, F.lit("")), full_name)


def clip_utf8(x: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut where a character begins, and a note of what was cut; 0 or less: no limit."""
    if limit <= 0:
        return x
    raw = F.encode(x, "UTF-8")

    def begins(at: int) -> Column:
        return ~F.hex(F.substring(raw, at + 1, 1)).between("80", "BF")

    cut = F.coalesce(*[F.when(begins(at), at) for at in range(limit, max(limit - 4, 0), -1)], F.lit(0))
    note = F.concat(F.lit("\n…[truncated, "), cut.cast("string"), F.lit(" of "), F.octet_length(x).cast("string"), F.lit(" bytes]"))
    return F.when(F.octet_length(x) <= limit, x).otherwise(F.concat(F.decode(raw.substr(F.lit(1), cut), "UTF-8"), note))


def sanitize(x: Column, limit: int = 256) -> Column:
    """Without control characters, at most ``limit`` bytes; a character that the cut splits goes."""
    clean = F.regexp_replace(x, r"[\x00-\x1f\x7f]", "")
    sizes = F.transform(F.split(clean, ""), F.octet_length)
    fits = F.aggregate(sizes, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")), lambda a, n: F.struct((a.bytes + n).alias("bytes"), (a.chars + F.when(a.bytes + n <= limit, 1).otherwise(0)).alias("chars")), lambda a: a.chars)
    return F.when(F.octet_length(clean) <= limit, clean).otherwise(F.left(clean, fits))


def has_cjk(x: Column) -> Column:
    return x.rlike("[一-鿿]")


def norm_label(norm: Column, label: Column) -> Column:
    """The stored normal form, else the lower-cased label without marks."""
    return F.coalesce(F.nullif(norm, F.lit("")), F.lower(strip_marks(label)))


def heading_level(line: Column) -> Column:
    """1-6 for an ATX heading line, else 0."""
    n = F.length(F.regexp_extract(F.ltrim(line), r"^(#{1,6}) ", 1))
    return F.coalesce(n, F.lit(0))


def first_heading(text: Column) -> Column:
    """Text of the first heading line, null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#{1,6} +(.*)$", 1)), F.lit(""))


def doc_title(manifest: Column, text: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(manifest, F.lit("")), first_heading(text), path)


def location_line(x: Column) -> Column:
    """Line of L42, L42-L60, line 42, 42:5; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(x), r"^(?:[Ll]ine )?[Ll]?(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def issue_time(x: Column) -> Column:
    """Timestamp of an issue tracker's text; unknown: null."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def wiki_time(x: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm")))


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def lower_words(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(x)), r"\s+"), lambda w: w != "")


def list_repr(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def normal_set(x: Column) -> Column:
    """Trimmed, lower-cased, distinct, non-empty values in their first order."""
    return F.array_distinct(F.filter(F.transform(x, lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def excerpt(x: Column, limit: int = 4000) -> Column:
    return F.left(x, F.lit(limit))


def labels_selected(labels: Column, include: list[str], exclude: list[str], trim: bool = True) -> Column:
    """Exclusions win; no inclusions mean all; case does not matter."""
    own = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v) if trim else v))
    wanted, unwanted = ([v.strip().lower() for v in x if v.strip()] for x in (include, exclude))
    overlap = lambda some: F.arrays_overlap(own, F.array(*[F.lit(v) for v in some]))
    out = ~overlap(unwanted) if unwanted else F.lit(True)
    return out & overlap(wanted) if wanted else out


def tri_state(present: Column, value: Column, stored: Column) -> Column:
    """Absent keeps the stored value; present replaces it, by null too."""
    return F.when(present, value).otherwise(stored)
