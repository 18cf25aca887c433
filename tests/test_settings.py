"""Settings laid over one another, encodings of pages, nested delimiters, progress of a running build."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import charset, markdown
from tessera.operators import settings as S
from tessera.streaming import ingest

STORED = {"base_url": "https://a", "user": "u", "api_token": "t", "project": "P", "jql": None, "include_labels": ["x"], "max_issues": 5}


@pytest.mark.parametrize(
    ("update", "changes"),
    [
        ({}, {}),
        ({"user": "v"}, {"user": "v"}),
        ({"user": None, "include_labels": None}, {"user": None, "include_labels": None}),
        ({"api_token": ""}, {}),
        ({"api_token": None}, {}),
        ({"api_token": "new", "max_issues": 0}, {"api_token": "new", "max_issues": 0}),
        ({"unknown": 1, "include_labels": []}, {"include_labels": []}),
    ],
)
def test_absent_keeps_null_clears_value_replaces(spark, update, changes):
    df = spark.createDataFrame([(json.dumps(STORED), json.dumps(update))], "stored string, update string")
    got = df.select(S.issue_config(F.col("stored"), F.col("update")).alias("c")).first().c.asDict()
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in (STORED | changes).items() if v is not None}


def test_envelope_updates(spark):
    stored = "struct('old' AS description, true AS analyze_images, 60000000000L AS refresh_interval, array('0 2 * * *') AS specs)"
    cases = {
        "{}": ("old", True, 60_000_000_000, ["0 2 * * *"], None),
        '{"description": " new "}': ("new", True, 60_000_000_000, ["0 2 * * *"], None),
        '{"description": null, "analyze_images": null, "specs": null}': ("", False, 60_000_000_000, [], None),
        '{"specs": [" @daily ", "", " "]}': ("old", True, 60_000_000_000, ["@daily"], None),
        '{"refresh_interval": "1h30m"}': ("old", True, 5_400_000_000_000, ["0 2 * * *"], None),
        '{"refresh_interval": "manual", "description": "x"}': ("x", True, 0, ["0 2 * * *"], None),
        '{"refresh_interval": null}': ("old", True, 0, ["0 2 * * *"], None),
        '{"refresh_interval": "soon", "description": "x"}': ("old", True, 60_000_000_000, ["0 2 * * *"], "refresh_interval"),
        "not json": ("old", True, 60_000_000_000, ["0 2 * * *"], None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: tuple(r.c) for r in df.select("u", S.collection_update(F.expr(stored), F.col("u")).alias("c")).collect()}
    assert got == cases


def test_durations(spark):
    want = {"90s": 90 * 10**9, "1h": 3600 * 10**9, "1.5h": 5400 * 10**9, "2m3.25s": 123_250_000_000, "-1m": -60 * 10**9, "10ms": 10**7, "": 0, "manual": 0, "0": 0, "5": None, "1d": None, "h": None}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r.x: r.d for r in df.select("x", S.duration(F.col("x")).alias("d")).collect()} == want


def test_filters_limits_and_ignores(spark):
    row = spark.range(1).select(
        S.merged_filters(F.expr("struct(array('a') AS include, array('b') AS include_extra, array('c') AS exclude)"), F.expr("struct(cast(array() AS array<string>) AS include, array('d', 'b') AS include_extra, cast(null AS array<string>) AS exclude)")).alias("f"),
        S.merged_filters(F.expr("struct(array('a') AS include, array('b') AS include_extra, array('c') AS exclude)"), F.expr("struct(array('z') AS include, array('b') AS include_extra, array('y') AS exclude)")).alias("g"),
        S.merged_limits(F.expr("struct(5 AS a, 6 AS b, 0 AS c)"), F.expr("struct(0 AS a, 9 AS b, -1 AS c)"), ("a", "b", "c")).alias("l"),
        S.merged_ignores(F.expr("array(' /x/ ', 'y', '')"), F.expr("array('y', '/z', 'x')")).alias("i"),
    ).first()
    assert tuple(row.f) == (["a"], ["b", "d", "b"], ["c"]) and tuple(row.g) == (["z"], ["b", "b"], ["c", "y"])
    assert tuple(row.l) == (5, 9, 0) and row.i == ["x", "y", "z"]


TEXT = "Größe naïve – “quoted” café"


@pytest.mark.parametrize(
    ("encoding", "header", "meta"),
    [
        ("utf-8", "", ""),
        ("utf-8", "text/html; charset=UTF-8", ""),
        ("cp1252", "text/html; charset=iso-8859-1", ""),
        ("cp1252", "text/html", '<meta charset="latin1">'),
        ("cp1252", "", '<meta http-equiv="Content-Type" content="text/html; charset=windows-1252">'),
        ("cp1252", "", ""),
        ("utf-16", "", ""),
        ("utf-16-le", "text/html; charset=utf-16le", ""),
        ("utf-16-be", "text/html; charset='utf-16be'", ""),
        ("utf-8-sig", "text/html; charset=iso-8859-1", ""),
        ("utf-8", "text/html; charset=nonsense", '<meta charset="utf-16">'),
    ],
)
def test_every_encoding_gives_the_same_text(encoding, header, meta):
    page = f"<html><head>{meta}</head><p>{TEXT}</p></html>"
    assert charset.decoded_page(page.encode(encoding), header) == page


def test_pages_as_columns(spark):
    df = spark.createDataFrame([(TEXT.encode("cp1252"), None), (b"", ""), (None, "x")], "body binary, kind string")
    assert [r[0] for r in df.select(charset.page_text(F.col("body"), F.col("kind"))).collect()] == [TEXT, "", None]


def stack_closers(text, opening, closing):
    """Written by hand: for every opening delimiter that is not escaped, count depth from it."""
    out, k = {}, 0
    while k < len(text):
        if text[k] == "\\":
            k += 2
            continue
        if text[k] == opening:
            depth, j = 0, k
            while j < len(text):
                if text[j] == "\\":
                    j += 2
                    continue
                depth += (text[j] == opening) - (text[j] == closing)
                if depth == 0:
                    out[k] = j
                    break
                j += 1
        k += 1
    return out


def test_closers_are_those_of_a_stack():
    import random

    rnd = random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice("[]()\\ab") for _ in range(rnd.randrange(25)))
        for pair in ("[]", "()"):
            assert markdown.closers(text, *pair) == stack_closers(text, *pair), text


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("[a](b)", "a"), ("see [a [b] c](u(v)w) d", "see a [b] c d"), ("![pic](x.png)!", "pic!"), ("[a](b", "[a](b"), ("[a]b](c)", "[a]b](c)"), ("[[x](y)](z)", "x"),
        ("[a][ref] [b] [c](d)", "a [b] c"), (r"\[a](b)", r"\[a](b)"), (r"[a\]](b)", r"a\]"), ("`[a](b)` [c](d)", "`[a](b)` c"), ("``a ` [x](y)`` z", "``a ` [x](y)`` z"), ("a ` [x](y)", "a ` x"),
        ("<https://a.b/c> <b>bold</b> 1 < 2", " bold 1 < 2"), ("<a href='x'", "<a href='x'"), ("[" * 2000 + "a", "[" * 2000 + "a"), ("[x](" * 500, "[x](" * 500),
    ],
)
def test_visible_text(text, shown):
    assert markdown.searchable(text) == shown


def test_progress_is_told_while_the_build_runs(spark, tmp_path):
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in" / "*"))
    told, at_step = [], []

    def step(batch, number):
        at_step.append((number, batch.count(), len(told)))

    done = ingest.build_with_progress(stream, 40, step, lambda n, total: told.append((n, total)))
    assert done == 40 and told[0] == (0, 40) and told[-1] == (40, 40)
    assert [n for n, _ in told] == sorted(n for n, _ in told) and len(told) >= 5
    assert [n for _, n, _ in at_step] == [10] * 4


def test_a_stream_goes_on_and_repeats_no_batch(spark, tmp_path):
    schema = "k long, ts long, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "one"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        return ingest.latest_by_key(stream, "k", ["ts"], root=str(tmp_path / "t"), log=str(tmp_path / "log"), buckets=4)

    assert {(r.k, r.n, r.v) for r in run().collect()} == {(1, 2, "c"), (2, 1, "b")}
    spark.createDataFrame([(2, 0, "late"), (3, 5, "d")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "two"))
    assert {(r.k, r.n, r.v) for r in run().collect()} == {(1, 2, "c"), (2, 2, "b"), (3, 1, "d")}
    assert {(r.k, r.n) for r in run().collect()} == {(1, 2), (2, 2), (3, 1)}
