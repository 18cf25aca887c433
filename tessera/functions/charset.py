"""The text of a web page's bytes: which encoding they are in is decided before anything is decoded."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tessera.functions.batches import small_batches

#: Bytes at the start of a page in which its own word about its encoding counts.
HEAD = 1024
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))
_META = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
# Names that browsers read as a wider encoding than they say.
_WIDER = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "gb2312": "gbk", "euc_kr": "cp949", "shift_jis": "cp932"}


def _known(label: str) -> str | None:
    """The codec of a label, wider where browsers read it so; None where there is none."""
    try:
        name = codecs.lookup(label.strip()).name
        "".encode(name)  # what is no text encoding raises
    except (LookupError, ValueError):
        return None
    return _WIDER.get(name, name)


def encoding_of(body: bytes, content_type: str = "") -> str:
    """A byte-order mark counts most, then the header, then a meta tag near the start, then whether the bytes are UTF-8."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return name
    told = re.search(r"charset\s*=\s*[\"']?\s*([^\s;\"']+)", content_type, re.I)
    if told and (name := _known(told[1])):
        return name
    meta = _META.search(body[:HEAD])
    if meta and (name := _known(meta[1].decode("ascii"))):
        return "utf-8" if name.startswith("utf-16") else name  # the tag could be read, so it is not UTF-16
    try:
        body.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def decoded_page(body: bytes, content_type: str = "") -> str:
    """The page's text without its mark; bytes that the encoding does not know become replacement characters."""
    name = encoding_of(body, content_type)
    for mark, own in _MARKS:
        if own == name and body.startswith(mark):
            body = body[len(mark) :]
    if name == "cp1252":  # five bytes have no sign there; browsers take them as they are
        return "".join(map(_LATIN.__getitem__, body))
    return body.decode(name, errors="replace")


_LATIN = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(256)]


@F.pandas_udf(ST.StringType())
def _decoded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for body, kind in parts:
        yield pd.Series([None if b is None else decoded_page(b, k or "") for b, k in zip(body, kind, strict=True)], dtype=object)


def page_text(body: Column, content_type: Column) -> Column:
    """Text of a column of pages' bytes; null stays null."""
    small_batches(SparkSession.active())
    return _decoded(body, content_type)
