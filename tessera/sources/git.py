"""History of a repository through the Data Source API: log, refs, diff, blame and changed files."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_COMMITS, MOST_REFS, MOST_FILES, MOST_PATCH = 200, 200, 1000, 256 << 10
_REVISION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/@^~+-]{0,254}")

SCHEMAS = {
    "log": "sha string, author string, email string, at long, subject string, body string, parents array<string>, files array<string>",
    "refs": "name string, kind string, sha string, at long, subject string",
    "diff": "status string, path string, old_path string",
    "blame": "line int, sha string, author string, at long, summary string, text string",
    "changed": "path string",
}


def valid_revision(rev: str) -> str:
    if not _REVISION.fullmatch(rev) or ".." in rev:
        raise ValueError(f"not a revision: {rev!r}")
    return rev


def revision_range(from_: str = "", to: str = "") -> str:
    """from..to, from..HEAD, or to alone."""
    a, b = (valid_revision(x) if x else "" for x in (from_, to))
    return f"{a}..{b or 'HEAD'}" if a else b or "HEAD"


def parse_log(text: str) -> Iterator[tuple]:
    """Records that start with 0x1e, of fields that 0x1f parts; the last field's lines are the files."""
    for record in text.split("\x1e")[1:]:
        sha, author, email, at, parents, subject, rest = record.split("\x1f", 6)
        body, _, files = rest.partition("\x1d")
        yield sha, author, email, int(at), subject, body.strip(), parents.split(), [f for f in files.split("\n") if f]


def parse_refs(text: str) -> Iterator[tuple]:
    for line in filter(None, text.split("\n")):
        name, sha, deref, at, subject = line.split("\x1f", 4)
        kind = {"refs/heads/": "branch", "refs/remotes/": "branch", "refs/tags/": "tag"}
        found = next((p for p in kind if name.startswith(p)), None)
        if found and not name.endswith("/HEAD"):
            yield name[len(found) :].removeprefix("origin/"), kind[found], deref or sha, int(at or 0), subject


def parse_status(text: str) -> Iterator[tuple]:
    """Lines of a status letter and one path, or two for renames."""
    for line in filter(None, text.split("\n")):
        status, *paths = line.split("\t")
        yield status[:1], paths[-1], paths[0] if len(paths) > 1 else None


def parse_blame(text: str) -> Iterator[tuple]:
    """Line-porcelain: a header line, keyed lines, and the content after a tab."""
    head: dict[str, str] = {}
    sha, number = "", 0
    for line in text.split("\n"):
        if line.startswith("\t"):
            yield number, sha, head.get("author", ""), int(head.get("author-time", 0)), head.get("summary", ""), line[1:]
            head = {}
        elif m := re.fullmatch(r"([0-9a-f]{40,64}) \d+ (\d+)(?: \d+)?", line):
            sha, number = m[1], int(m[2])
        elif " " in line:
            k, _, v = line.partition(" ")
            head[k] = v


class GitDataSource(DataSource):
    """``spark.read.format("tessera_git")`` with options path, what (log, refs, diff, blame, changed), from, to, file, skip, limit.

    One command is one partition; the repository must be readable where the task runs.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "log")]

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self):
        return [InputPartition(0)]

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.o["path"], *args], capture_output=True, check=True).stdout.decode(errors="replace")

    def read(self, partition) -> Iterator[tuple]:
        what, a, b, file = (self.o.get(k, d) for k, d in (("what", "log"), ("from", ""), ("to", ""), ("file", "")))
        tail = ["--", file] if file else []
        if what == "log":
            n = min(MOST_COMMITS, int(self.o.get("limit", MOST_COMMITS)))
            form = "--format=%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%P%x1f%s%x1f%b%x1d"
            yield from parse_log(self._git("log", "--no-merges", "--name-only", form, f"--skip={int(self.o.get('skip', 0))}", f"-{n}", revision_range(a, b), *tail))
        elif what == "refs":
            form = "--format=%(refname)%1f%(objectname)%1f%(*objectname)%1f%(creatordate:unix)%1f%(subject)"
            yield from list(parse_refs(self._git("for-each-ref", "--sort=-creatordate", form, "refs/heads", "refs/remotes", "refs/tags")))[:MOST_REFS]
        elif what == "diff":
            yield from list(parse_status(self._git("diff", "--name-status", valid_revision(a), valid_revision(b or "HEAD"), *tail)))[:MOST_FILES]
        elif what == "changed":
            yield from ((p,) for p in self._git("diff", "--name-only", "--no-renames", valid_revision(a), valid_revision(b or "HEAD")).split("\n") if p)
        elif what == "blame":
            yield from parse_blame(self._git("blame", "--line-porcelain", valid_revision(b or "HEAD"), "--", file))
        else:
            raise ValueError(f"unknown: {what}")


def patch(path: str, from_: str, to: str = "HEAD") -> tuple[str, bool]:
    """A diff's text, at most 256 KiB, and whether it was cut."""
    out = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "diff", valid_revision(from_), valid_revision(to)], capture_output=True, check=True).stdout
    return out[:MOST_PATCH].decode(errors="ignore"), len(out) > MOST_PATCH
