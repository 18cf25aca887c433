"""Issue trackers, wikis, pages and sitemaps through the Data Source API.

A connector asks a transport for JSON or bytes: http(s) through the standard library, or a
folder of recorded answers (``file:``), which tests use. Streams carry the watermark as their
offset; reading again from the watermark is harmless because sinks upsert by key and hash.
"""

from __future__ import annotations

import gzip
import json
import os
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tessera.functions.charset import decoded_page
from tessera.functions.markdown import article, html_to_markdown, rich_text
from tessera.operators.sync import bounded_query, wiki_query

MOST_JSON, MOST_PAGE, MOST_SITEMAP, MOST_FILES, MOST_URLS, ISSUE_PAGE = 64 << 20, 8 << 20, 50 << 20, 100, 50_000, 50

ISSUES = "key string, title string, markdown string, labels array<string>, kind string, teams array<string>, updated string, error string"
WIKI = "id string, title string, markdown string, labels array<string>, updated string, error string"
PAGES = "url string, title string, markdown string, error string"


def _get(url: str, headers: dict[str, str] | None, most: int, accept: tuple[str, ...]) -> tuple[bytes, str, str]:
    """(body, final address, content type); a file's type is not told."""
    kind = ""
    if url.startswith("file:"):
        with open(urllib.parse.unquote(urllib.parse.urlparse(url).path), "rb") as f:
            body, final = f.read(most + 1), url
    else:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=60) as r:
            kind = r.headers.get("Content-Type", "")
            if accept and r.headers.get_content_type() not in accept:
                raise ValueError(f"unexpected type {r.headers.get_content_type()}")
            body, final = r.read(most + 1), r.geturl()
    if len(body) > most:
        raise ValueError("the answer is too large")
    return body, final, kind


def fetch(url: str, headers: dict[str, str] | None = None, most: int = MOST_JSON, accept: tuple[str, ...] = ()) -> tuple[bytes, str]:
    """(body, final address); refuses other types than ``accept`` and bodies over ``most``."""
    return _get(url, headers, most, accept)[:2]


def fetch_page(url: str, headers: dict[str, str] | None = None, most: int = MOST_PAGE) -> tuple[str, str]:
    """(text, final address) of a page, decoded by its mark, its header, its own word, or its bytes."""
    body, final, kind = _get(url, headers, most, ("text/html", "application/xhtml+xml"))
    return decoded_page(body, kind), final


def _headers(options: dict) -> dict[str, str]:
    if options.get("token"):
        return {"Authorization": f"Bearer {options['token']}"}
    if options.get("user"):
        import base64

        return {"Authorization": "Basic " + base64.b64encode(f"{options['user']}:{options.get('password', '')}".encode()).decode()}
    return {}


def _answer(options: dict, path: str, query: dict) -> dict:
    """JSON of a request; a folder holds the answers of page n as ``n.json``."""
    base = options["url"].rstrip("/")
    if base.startswith("file:"):
        name = f"{base}/{query.get('startAt', query.get('start', 0))}.json"
        if not os.path.exists(urllib.parse.unquote(urllib.parse.urlparse(name).path)):
            return {}
        return json.loads(fetch(name)[0])
    return json.loads(fetch(f"{base}{path}?{urllib.parse.urlencode(query)}", _headers(options))[0])


def field_values(x) -> list[str]:
    """Values of a custom field: text, list, or an object's value, display name or name."""
    if x is None:
        return []
    if isinstance(x, list):
        return [v for y in x for v in field_values(y)]
    if isinstance(x, dict):
        return next(([str(x[k]).strip()] for k in ("value", "displayName", "name") if x.get(k)), [])
    return [str(x).strip()] if str(x).strip() else []


def distinct_fold(values: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for v in values:
        seen.setdefault(v.casefold(), v)
    return list(seen.values())


def render_issue(issue: dict, teams: list[str] = ()) -> str:
    """An issue as markdown: key and title, what is known of it, its teams, and its description under a heading."""
    f = issue.get("fields") or {}

    def name(k: str, part: str = "name") -> str:
        return str((f.get(k) or {}).get(part) or "")

    # The order and names of what is known of an issue.
    known = {
        "Key": issue.get("key") or "", "Type": name("issuetype"), "Status": name("status"), "Priority": name("priority"),
        "Assignee": name("assignee", "displayName"), "Reporter": name("reporter", "displayName"), "Created": f.get("created") or "", "Updated": f.get("updated") or "",
        "Labels": ", ".join(f.get("labels") or []), "Teams": ", ".join(teams),
    }
    head = f"# {issue.get('key') or ''}: {(f.get('summary') or '').strip()}\n\n"
    told = "".join(f"- **{k}:** {v}\n" for k, v in known.items() if v.strip())
    text = rich_text(f.get("description")).strip()
    return head + told + (f"\n## Description\n\n{text}\n" if text else "")


def issues(options: dict, watermark: datetime | None) -> Iterator[tuple]:
    """Rows of all issues in update order, page by page; a bad issue is a row with its error."""
    query, start = bounded_query(options.get("query", ""), watermark), 0
    fields = [x for x in options.get("teamfields", "").split(",") if x]
    while True:
        got = _answer(options, "/rest/api/2/search", {"jql": query, "startAt": start, "maxResults": ISSUE_PAGE})
        some = got.get("issues") or []
        for i in some:
            f = i.get("fields") or {}
            updated = f.get("updated")
            try:
                teams = distinct_fold([v for k in fields for v in field_values(f.get(k))])
                yield i["key"], f.get("summary"), render_issue(i, teams), list(f.get("labels") or []), (f.get("issuetype") or {}).get("name"), teams, updated, None
            except Exception as e:  # one bad issue does not stop a sweep
                yield i.get("key"), None, None, [], None, [], updated, str(e)
        start += len(some)
        if not some or start >= int(got.get("total", 0)):
            return


def wiki_pages(options: dict, watermark: datetime | None) -> Iterator[tuple]:
    """Rows of all pages; stops where the next page is one that was read already."""
    query, start, seen = wiki_query(options.get("space", ""), options.get("ancestor", ""), watermark), 0, set()
    while start not in seen:
        seen.add(start)
        got = _answer(options, "/rest/api/content/search", {"cql": query, "start": start, "limit": 50, "expand": "body.view,metadata.labels,version,ancestors"})
        for p in got.get("results") or []:
            updated = ((p.get("version") or {}).get("when")) or None
            try:
                trail = " › ".join(a["title"] for a in p.get("ancestors") or [] if a.get("title"))
                body = html_to_markdown((((p.get("body") or {}).get("view") or {}).get("value")) or "", options["url"])
                labels = [x.get("name", "") for x in ((p.get("metadata") or {}).get("labels") or {}).get("results") or []]
                yield str(p["id"]), p.get("title"), (f"> {trail}\n\n" if trail else "") + body, labels, updated, None
            except Exception as e:
                yield str(p.get("id")), None, None, [], updated, str(e)
        nxt = (got.get("_links") or {}).get("next")
        if not nxt:
            return
        start = int(urllib.parse.parse_qs(urllib.parse.urlparse(nxt).query).get("start", [0])[0])


def _time(x: str | None) -> datetime | None:
    try:
        return datetime.strptime(x, "%Y-%m-%dT%H:%M:%S.%f%z").replace(tzinfo=None) if x else None
    except ValueError:
        try:
            return datetime.fromisoformat(x).replace(tzinfo=None)
        except ValueError:
            return None


def _advance(watermark: datetime | None, rows: list[tuple], at: int) -> datetime | None:
    """The latest update seen less a minute, to the minute; unchanged where nothing was seen."""
    seen = [t for t in (_time(r[at]) for r in rows) if t]
    return (max(seen) - timedelta(minutes=1)).replace(second=0, microsecond=0) if seen else watermark


def _lower(options) -> dict[str, str]:
    return {k.lower(): v for k, v in options.items()}  # names of options have no case


class _Reader(DataSourceReader):
    def __init__(self, fn, options):
        self.fn, self.options = fn, _lower(options)

    def partitions(self):
        return [InputPartition(0)]  # pages follow one another

    def read(self, partition):
        since = self.options.get("since")
        yield from self.fn(self.options, datetime.fromisoformat(since) if since else None)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, fn, options, at):
        self.fn, self.options, self.at = fn, _lower(options), at

    def initialOffset(self) -> dict:
        return {"watermark": self.options.get("since") or "", "rows": 0}

    def read(self, start: dict):
        mark = datetime.fromisoformat(start["watermark"]) if start["watermark"] else None
        rows = list(self.fn(self.options, mark))
        new = _advance(mark, rows, self.at)
        if new == mark and start["rows"]:
            return iter([]), start
        return iter(rows), {"watermark": new.isoformat() if new else "", "rows": start["rows"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        mark = datetime.fromisoformat(start["watermark"]) if start["watermark"] else None
        return iter(list(self.fn(self.options, mark)))


class IssueDataSource(DataSource):
    """``tessera_issues``: url, query, teamFields, since, and token or user and password."""

    @classmethod
    def name(cls) -> str:
        return "tessera_issues"

    def schema(self) -> str:
        return ISSUES

    def reader(self, schema):
        return _Reader(issues, self.options)

    def simpleStreamReader(self, schema):
        return _Stream(issues, self.options, 6)


class WikiDataSource(DataSource):
    """``tessera_wiki``: url, space, ancestor, since, and token or user and password."""

    @classmethod
    def name(cls) -> str:
        return "tessera_wiki"

    def schema(self) -> str:
        return WIKI

    def reader(self, schema):
        return _Reader(wiki_pages, self.options)

    def simpleStreamReader(self, schema):
        return _Stream(wiki_pages, self.options, 4)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        url = partition.value
        try:
            title, text = article(*fetch_page(url))
            yield url, title, text, None
        except Exception as e:
            yield url, None, None, str(e)


class PageDataSource(DataSource):
    """``tessera_pages``: urls, one a line; a page that cannot be read is a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "tessera_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema):
        return _PageReader(self.options)


def sitemap_urls(url: str) -> list[str]:
    """Addresses of a sitemap and of the sitemaps it names, of its own origin, each once; 100 files and 50,000 addresses at most."""
    origin = urllib.parse.urlparse(url)[:2]
    todo, seen, out = [url], set(), {}
    while todo and len(seen) < MOST_FILES:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        body, _ = fetch(at, most=MOST_SITEMAP)
        if body[:2] == b"\x1f\x8b":
            body = gzip.decompress(body)
        root = ET.fromstring(body)
        locs = [e.text.strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()]
        own = [x for x in locs if tuple(y.lower() for y in urllib.parse.urlparse(x)[:2]) == tuple(y.lower() for y in origin)]
        if root.tag.rpartition("}")[2] == "sitemapindex":
            todo += own
        else:
            out.update(dict.fromkeys(own))
        if len(out) >= MOST_URLS:
            break
    return list(out)[:MOST_URLS]


def register(spark) -> None:
    """Make the sources of this package known to a session."""
    from tessera.sources.git import GitDataSource

    for s in (IssueDataSource, WikiDataSource, PageDataSource, GitDataSource):
        spark.dataSource.register(s)


def preview(kind: str, options: dict, include: list[str] = (), exclude: list[str] = (), limit: int = 1000) -> dict[str, int | bool]:
    """How many rows a source would give: scanned, selected by labels, and whether the limit cut it short."""
    wanted, unwanted = ({x.strip().lower() for x in some if x.strip()} for some in (include, exclude))
    at = {"jira": (issues, 3), "confluence": (wiki_pages, 3)}[kind]
    scanned = chosen = 0
    for row in at[0](_lower(options), None):
        if scanned == limit:
            return {"scanned": scanned, "selected": chosen, "limit": limit, "truncated": True}
        own = {x.strip().lower() for x in row[at[1]] or []}
        scanned += 1
        chosen += not own & unwanted and (not wanted or bool(own & wanted))
    return {"scanned": scanned, "selected": chosen, "limit": limit, "truncated": False}


def public_url(url: str, allow_private: bool = False) -> bool:
    """An absolute http(s) address without user info that does not name this machine or a private network."""
    import ipaddress

    u = urllib.parse.urlparse(url)
    if u.scheme.lower() not in ("http", "https") or not u.hostname or u.username is not None:
        return False
    host = u.hostname.lower().rstrip(".")
    if allow_private:
        return True
    if host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified)


def data_url(url: str, most: int = 8 << 20) -> bytes:
    """Bytes of a base64 image in a data address; PNG, JPEG and GIF only."""
    import base64
    import re

    m = re.fullmatch(r"data:image/(?:png|jpe?g|gif);base64,([A-Za-z0-9+/=\s]+)", url)
    if not m or len(m[1]) * 3 // 4 > most:
        raise ValueError("not an image of a known kind and size")
    return base64.b64decode(m[1])
