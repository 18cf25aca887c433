"""Markdown, HTML and source text: projection for search, chunking, links and images.

These are grammars with nesting and state, which no built-in column function expresses; they
run as pandas UDFs over Arrow batches, one document at a time. Sizes are in UTF-8 bytes.
"""

from __future__ import annotations

import json
import re as _re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.batches import small_batches

LEXICAL_SIZE, LEXICAL_OVERLAP = 1200, 200
CODE_SIZE, CODE_OVERLAP = 3000, 1000

_FENCE = _re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = _re.compile(r"\s*(#{1,6}) (.*)")
#: Where something other than plain text may begin.
_MARK = _re.compile(r"\\.|`+|!?\[|<", _re.S)
_TAG = _re.compile(r"<(?:https?://|[/!?A-Za-z])", _re.I)
_DEFINITION = regex.compile(r"^ {0,3}(?P<label>\[(?:\\.|[^\[\]\\\n]|(?&label))*+\]):[ \t]*(?P<rest>[^\n]*)$")


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; no other sign ends a line."""
    return [x for x in _re.split(r"(?<=\n)", text) if x]


def _blocks(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is code, lines) of a text: fenced and indented code, and prose between."""
    fence, held, code = None, [], False
    for line in _lines(text):
        mark = _FENCE.match(line)
        raw = fence is not None or mark is not None or line.startswith(("    ", "\t"))
        if raw != code and held:
            yield code, "".join(held)
            held = []
        code = raw
        held.append(line)
        if mark and fence is None:
            fence = mark[1]
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
            fence = None
    if held:
        yield code, "".join(held)


def _no_definitions(prose: str) -> str:
    """Without ``[name]: target "title"`` lines, their targets and titles on lines of their own too."""
    out, want = [], ""
    for line in _lines(prose):
        bare = line.strip()
        hanging = line[:1] in (" ", "\t") and bool(bare)
        if want == "target" and hanging:
            want = "title"
            continue
        if want == "title" and hanging and bare[0] in "\"'(" and len(bare) > 1:
            want = ""
            continue
        found = _DEFINITION.match(line.rstrip("\n"))
        want = "" if not found else "title" if found["rest"].strip() else "target"
        if not found:
            out.append(line)
    return "".join(out)


def closers(text: str, opening: str, closing: str) -> dict[int, int]:
    """Where each delimiter is closed again, nesting counted, in one pass; what a backslash precedes is text."""
    out: dict[int, int] = {}
    open_: list[int] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == opening:
            open_.append(at)
        elif c == closing and open_:
            out[open_.pop()] = at
        at += 1
    return out


def searchable(text: str | None) -> str | None:
    """What a reader sees: labels and code stay, destinations, definitions, autolinks and tags go."""
    return None if text is None else "".join(b if code else _visible(_no_definitions(b)) for code, b in _blocks(text))


def _visible(prose: str) -> str:
    """Prose without link targets, autolinks and tags; a label is shown as what it holds.

    The text is walked once, from one mark to the next; delimiters know their ends beforehand.
    A mark that begins nothing whole is text.
    """
    if not _MARK.search(prose):
        return prose
    square, round_ = closers(prose, "[", "]"), closers(prose, "(", ")")
    last_angle, unclosed = prose.rfind(">"), set()
    out, at = [], 0
    while found := _MARK.search(prose, at):
        out.append(prose[at : found.start()])
        at, mark = found.start(), found[0]
        end, shown = at + 1, prose[at]
        if mark[0] == "\\":
            end, shown = found.end(), mark
        elif mark[0] == "`":
            close = -1 if len(mark) in unclosed else prose.find(mark, found.end())
            if close >= 0:
                end = close + len(mark)
                shown = prose[at:end]
            else:
                unclosed.add(len(mark))
        elif mark == "<":
            if _TAG.match(prose, at) and last_angle > at:
                end, shown = prose.index(">", at) + 1, ""
        else:
            label = found.end() - 1
            stop = square.get(label, len(prose))
            target = {"(": round_, "[": square}.get(prose[stop + 1 : stop + 2], {}).get(stop + 1)
            if target is not None:
                end, shown = target + 1, "".join(b if code else _visible(b) for code, b in _blocks(prose[label + 1 : stop]))
        out.append(shown)
        at = end
    return "".join([*out, prose[at:]])


def first_heading(text: str) -> str:
    return next((m[2].strip() for m in map(_HEADING.fullmatch, text.split("\n")) if m), "")


def titled(text: str, title: str) -> str:
    """The text under its title, unless its first heading is that already."""
    text, title = text.strip(), title.strip()
    return text if not title or first_heading(text).casefold() == title.casefold() else f"# {title}\n\n{text}"


def _size(s: str) -> int:
    return len(s.encode())


def _sections(text: str) -> list[str]:
    """The text cut before headings that stand outside fences."""
    lines, fenced, cuts = text.split("\n"), False, [0]
    for k, line in enumerate(lines):
        bare = line.strip()
        fenced ^= bare.startswith(("```", "~~~"))
        if k and not fenced and _HEADING.fullmatch(bare):
            cuts.append(k)
    parts = ("\n".join(lines[a:b]).strip() for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True))
    return [p for p in parts if p]


def _spans(total: int, line_ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of windows of at most ``size``; a window ends at its last line end if that lies past half a step.

    ``step`` is how far the next window starts from this one: the window less the overlap.
    """
    start, step = 0, size - overlap
    while start < total:
        stop = min(total, start + size)
        if stop < total:
            before = bisect_left(line_ends, stop) - 1
            if before >= 0 and line_ends[before] - start > step // 2:
                stop = line_ends[before]
            length = stop - start
            step = length - overlap if length > overlap else length
        yield start, stop
        start = total if stop == total else start + step


def _windows(section: str, size: int, overlap: int) -> list[str]:
    """Overlapping pieces of at most ``size`` bytes, cut at line ends where one lies far enough on."""
    raw = section.encode()
    line_ends = [m.start() for m in _re.finditer(b"\n", raw)]
    found = (raw[a:b].decode(errors="replace").strip() for a, b in _spans(len(raw), line_ends, size, overlap))
    return [t for t in found if t]


def chunks(text: str | None, size: int = LEXICAL_SIZE, overlap: int = LEXICAL_OVERLAP) -> list[str]:
    """Sections packed into chunks of at most ``size`` bytes; a larger section goes in overlapping windows."""
    size = size if size > 0 else LEXICAL_SIZE
    overlap = max(0, overlap) if overlap < size else size // 4
    out: list[str] = []
    pack: list[str] = []
    used = 0
    for s in _sections(text or ""):
        n = _size(s)
        if pack and (n > size or used + 1 + n > size):
            out.append("\n".join(pack))
            pack, used = [], 0
        if n > size:
            out += _windows(s, size, overlap)
        else:
            used += n + bool(pack)
            pack.append(s)
    if pack:
        out.append("\n".join(pack))
    return out


class CodeChunk(NamedTuple):
    text: str
    symbol: str
    start_line: int
    end_line: int


def _line_windows(lines: list[str], first: int, symbol: str, size: int, overlap: int) -> Iterator[CodeChunk]:
    """Whole lines up to ``size`` bytes, the next window a little back, but always further on."""
    ends = list(accumulate(_size(x) + 1 for x in lines))  # with line ends
    at = 0
    while at < len(lines):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, bisect_right(ends, base + size + 1))
        yield CodeChunk(_capped("\n".join(lines[at:stop]), size), symbol, first + at, first + stop - 1)
        if stop >= len(lines):
            return
        back = bisect_right(ends, ends[stop - 1] - overlap, at, stop)  # first line that the overlap takes in
        at = max(at + 1, back if overlap else stop)


def _capped(text: str, size: int) -> str:
    raw = text.encode()
    return text if len(raw) <= 2 * size else raw[: 2 * size].decode(errors="replace")


def code_chunks(content: str | None, symbols: list[tuple[int, str]] = (), size: int = CODE_SIZE, overlap: int = CODE_OVERLAP) -> list[CodeChunk]:
    """Chunks of a source file that begin at symbols (line, name), small neighbours together.

    Without symbols, and within a symbol larger than ``size`` bytes, windows of lines.
    """
    if not content or not content.strip():
        return []
    size = size if size > 0 else CODE_SIZE
    overlap = overlap if 0 <= overlap < size else size // 3
    lines = content.split("\n")
    named: dict[int, str] = {}
    for line, name in sorted(symbols):
        if 1 <= line <= len(lines):
            named.setdefault(line, name)
    if not named:
        found = _line_windows(lines, 1, "", size, overlap)
        return [c for c in found if c.text.strip()]
    starts = sorted({1, *named})
    spans = [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(lines) + 1], strict=True)]
    out: list[CodeChunk] = []
    group: tuple[int, int, int, str] | None = None  # first line, last line, bytes, symbol

    def close() -> None:
        if group:
            out.append(CodeChunk(_capped("\n".join(lines[group[0] - 1 : group[1]]), size), group[3], group[0], group[1]))

    for a, b in spans:
        n, name = _size("\n".join(lines[a - 1 : b])), named.get(a, "")
        if n > size:
            close()
            group = None
            out += [c for c in _line_windows(lines[a - 1 : b], a, name, size, overlap) if c.text.strip()]
        elif group and group[2] + n + 1 <= size:
            group = (group[0], b, group[2] + n + 1, group[3] or name)
        else:
            close()
            group = (a, b, n, name)
    close()
    return out


class Image(NamedTuple):
    start: int
    end: int
    alt: str
    url: str


_IMAGE = regex.compile(r"(?s)!(?P<label>\[(?:\\.|[^\[\]\\]|(?&label))*+\])(?P<target>\((?:\\.|<[^>]*>|[^()\\]|(?&target))*+\))")


def images(text: str | None) -> list[Image]:
    """``![alt](url "title")`` with nested brackets and ``<url>`` targets; places are code points."""
    out = []
    for m in _IMAGE.finditer(text or ""):
        inside = m["target"][1:-1].strip()
        url = inside[1 : inside.index(">")] if inside.startswith("<") and ">" in inside else (inside.split() or [""])[0]
        if url:
            out.append(Image(m.start(), m.end(), m["label"][1:-1], url))
    return out


_BLOCK_TAGS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "hr"}
_HIDDEN_TAGS = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "svg", "iframe"}


class _Markdown(HTMLParser):
    """Writes markdown of the visible parts, links made absolute."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.title = base, [], ""
        self.hidden, self.in_title, self.pre, self.lists, self.links, self.scope = 0, False, 0, [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN_TAGS:
            self.hidden += 1
        if tag == "title":
            self.in_title = True
        if self.hidden:
            return
        if tag in _BLOCK_TAGS:
            self.out.append("\n\n" if tag not in ("li", "br", "tr") else "\n")
        if tag[:1] == "h" and tag[1:] in "123456" and len(tag) == 2:
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append(urljoin(self.base, a["href"]) if a.get("href") else "")
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img" and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({urljoin(self.base, a['src'])})")
        elif tag == "blockquote":
            self.out.append("> ")

    def handle_endtag(self, tag):
        if tag in _HIDDEN_TAGS and self.hidden:
            self.hidden -= 1
            return
        if tag == "title":
            self.in_title = False
        if self.hidden:
            return
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in _BLOCK_TAGS and tag not in ("li", "br", "tr"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(data if self.pre else _re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = _re.sub(r"[ \t]+\n", "\n", "".join(self.out))
        return _re.sub(r"\n{3,}", "\n\n", _re.sub(r"(?m)^ +(?=\S)(?![ ]*(?:-|\d+\.) )", "", text)).strip()


def html_to_markdown(html: str | None, base: str = "") -> str:
    p = _Markdown(base or "")
    p.feed(html or "")
    p.close()
    return p.markdown()


def article(html: str | None, base: str = "") -> tuple[str, str]:
    """(title, markdown) of the main part: <article> or <main> if it says anything, else all."""
    html = html or ""
    whole = _Markdown(base or "")
    whole.feed(html)
    whole.close()
    for tag in ("article", "main"):
        m = _re.search(rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", html)
        if m and (text := html_to_markdown(m[1], base)):
            return " ".join(whole.title.split()), text
    return " ".join(whole.title.split()), whole.markdown()


def rich_text(value) -> str:
    """Text of a rich-text document (nested nodes with ``type``, ``text``, ``content``) or a plain string."""
    if value is None:
        return ""
    if isinstance(value, str):
        try:
            node = json.loads(value)
        except ValueError:
            return value
        if not isinstance(node, dict):
            return value
        value = node
    if isinstance(value, list):
        return "".join(map(rich_text, value))
    kind = value.get("type", "")
    inner = value.get("text", "") + "".join(rich_text(c) for c in value.get("content", []))
    if kind == "hardBreak":
        return "\n"
    block = kind in ("paragraph", "heading", "bulletList", "orderedList", "listItem", "codeBlock", "blockquote", "table", "tableRow")
    return inner + "\n\n" if block else inner


_FILE_HEADING = _re.compile(r"(?:#{2,3} +`?([^`#]+?)`?|=+ *FILE: *`?([^`=]+?)`? *=+)\s*")


def summary_sections(text: str | None, files: list[str]) -> dict[str, str]:
    """Bodies by file of a written summary: headings that name one of the files begin a section."""
    out: dict[str, list[str]] = {}
    at = None
    for line in (text or "").split("\n"):
        m = _FILE_HEADING.fullmatch(line.strip())
        name = (m[1] or m[2]).strip() if m else None
        if name in files:
            at = out.setdefault(name, [])
        elif at is not None:
            at.append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


#: Between the summaries of files, and the bytes that each keeps at least when all are cut.
SUMMARY_RULE, SUMMARY_LEAST = "\n\n---\n\n", 400


def join_summaries(parts: list[str], budget: int) -> str:
    """Parts joined by rules; over the budget, all cut to an equal share of at least 400 bytes."""
    whole = SUMMARY_RULE.join(parts)
    if _size(whole) <= budget or not parts:
        return whole
    share = max(SUMMARY_LEAST, budget // len(parts))
    return SUMMARY_RULE.join(p if _size(p) <= share else p.encode()[:share].decode(errors="ignore") for p in parts)


def _udf(fn: Callable, returns: str):
    small_batches(SparkSession.active())

    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*cols, strict=True)], dtype=object)

    return run


def searchable_column(text: Column) -> Column:
    return _udf(searchable, "string")(text)


def html_column(html: Column, url: Column) -> Column:
    """Struct of the article's title and markdown."""
    small_batches(SparkSession.active())

    @F.pandas_udf("struct<title string, markdown string>")
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(a, b) for a, b in zip(h, u, strict=True)], columns=["title", "markdown"])

    return run(html, url)


def with_chunks(df: DataFrame, text: str, size: int = LEXICAL_SIZE, overlap: int = LEXICAL_OVERLAP) -> DataFrame:
    """A row for each chunk: ``i`` from 0 and ``chunk``."""
    cut = _udf(lambda t: chunks(t, size, overlap), "array<string>")
    return df.select("*", F.posexplode(cut(F.col(text))).alias("i", "chunk"))


def with_code_chunks(df: DataFrame, text: str, symbols: str | None = None, size: int = CODE_SIZE, overlap: int = CODE_OVERLAP) -> DataFrame:
    """A row for each chunk of a file: ``i``, text, symbol and lines; ``symbols`` is array<struct<line, name>>."""
    shape = "array<struct<text string, symbol string, start_line int, end_line int>>"
    if symbols:
        cut = _udf(lambda t, s: [c._asdict() for c in code_chunks(t, [(x["line"], x["name"]) for x in (s if s is not None else ())], size, overlap)], shape)(F.col(text), F.col(symbols))
    else:
        cut = _udf(lambda t: [c._asdict() for c in code_chunks(t, (), size, overlap)], shape)(F.col(text))
    rest = [c for c in df.columns if c not in ("text", "symbol", "start_line", "end_line", "i")]
    return df.select(*rest, F.posexplode(cut).alias("i", "_c")).select(*rest, "i", "_c.*")


def with_images(df: DataFrame, text: str) -> DataFrame:
    found = _udf(lambda t: [i._asdict() for i in images(t)], "array<struct<start int, end int, alt string, url string>>")
    return df.select("*", F.explode(found(F.col(text))).alias("image"))
