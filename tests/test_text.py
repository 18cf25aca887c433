import pytest
from pyspark.sql import functions as F

from tessera.functions import globs
from tessera.functions import markdown as M
from tessera.functions import text as TX


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_workers_get_bounded_batches(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    M.searchable_column(F.col("text"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20


def test_slugs_hashes_and_urls(spark):
    assert one(spark, [("  Wine & Food / 2026  ",), ("",), (None,), ("é!",), ("a" * 100,)], "x string", TX.slugify(F.col("x"))) == ["wine-food-2026", "page", "page", "page", "a" * 80]
    assert one(spark, [("abc",)], "x string", TX.content_hash(F.col("x"))) == ["ba7816bf8f01cfea414140de5dae2223"]
    pairs = [("https://A.b:80/x", "HTTPS://a.B:80/y"), ("https://a/x", "http://a/x"), ("https://a:1/", "https://a/"), (None, "x")]
    assert one(spark, pairs, "a string, b string", TX.same_origin(F.col("a"), F.col("b"))) == [True, False, False, False]
    assert one(spark, [("https://x.y/p",), ("http://u@x.y/",), ("ftp://x",), ("/rel",), (None,)], "u string", TX.http_url_ok(F.col("u"))) == [True, False, False, False, False]
    urls = [("https://user:pw@github.com/acme/pay.git",), ("git@github.com:acme/pay.git",), ("ssh://git@host:2222/a/b",), ("https://h/a/b/",)]
    assert one(spark, urls, "u string", TX.repo_id(F.col("u"))) == ["github.com/acme/pay", "github.com/acme/pay", "host/a/b", "h/a/b"]


def test_small_functions(spark):
    assert one(spark, [("a\x00b\n",), ("é" * 200,), (None,)], "x string", TX.sanitize(F.col("x"))) == ["ab", "é" * 128, None]
    assert one(spark, [("L42",), ("L42-L60",), ("line 42",), ("42:5",), ("x",), (None,)], "x string", TX.location_line(F.col("x"))) == [42, 42, 42, 42, 0, 0]
    assert one(spark, [("x\n## Two words\n# y",), ("#no",), (None,)], "x string", TX.first_heading(F.col("x"))) == ["Two words", None, None]
    assert one(spark, [(["A", " b ", "a", ""],), (None,)], "x array<string>", TX.normal_set(F.col("x"))) == [["a", "b"], None]
    assert one(spark, [("Ünïcode Ⅷ",)], "x string", TX.strip_marks(F.col("x"))) == ["Unicode VIII"]
    times = [("2024-05-01T10:00:00.000+0200",), ("2024-05-01T08:00:00Z",), ("nonsense",)]
    assert [str(t) for t in one(spark, times, "x string", TX.issue_time(F.col("x")))] == ["2024-05-01 08:00:00", "2024-05-01 08:00:00", "None"]
    assert [str(t) for t in one(spark, [("2024-05-01 08:00",), ("x",)], "x string", TX.wiki_time(F.col("x")))] == ["2024-05-01 08:00:00", "None"]
    assert one(spark, [(["a", "b"],)], "x array<string>", TX.list_repr(F.col("x"))) == ["['a', 'b']"]
    assert one(spark, [("PAY-1842 für x_y",)], "x string", TX.tokens(F.col("x"))) == [["pay-1842", "für", "x_y"]]
    assert one(spark, [(True, None, "s"), (False, None, "s"), (True, "v", "s")], "p boolean, v string, s string", TX.tri_state(F.col("p"), F.col("v"), F.col("s"))) == [None, "s", "v"]


def test_label_filter(spark):
    rows = [(["Bug", "ops"],), (["docs"],), ([],), (None,)]
    f = lambda i, e: one(spark, rows, "l array<string>", TX.labels_selected(F.col("l"), i, e))
    assert f([], []) == [True] * 4
    assert f(["bug"], []) == [True, False, False, False]
    assert f(["bug", "docs"], ["OPS"]) == [False, True, False, False]


def test_projection():
    shown = M.searchable("see [the *label*](http://x/(a)) ![alt](i.png) <https://a.b><b>bold</b> `[code](x)` \\[no](y)")
    assert shown == "see the *label* alt bold `[code](x)` \\[no](y)"
    assert M.searchable("```\n[kept](z)\n```\n    [kept](too)\n[a [nested](x) b](y)\n") == "```\n[kept](z)\n```\n    [kept](too)\na nested b\n"
    assert M.searchable('[ref]: http://x "t"\n[two]:\n  http://y\n  "title"\ntext [a][ref]') == "text a"
    assert M.searchable(None) is None and M.searchable("") == ""
    assert M.titled("# Same\nx", "same") == "# Same\nx" and M.titled("x", "T") == "# T\n\nx"


def test_chunks():
    assert M.chunks("# A\naaa\n# B\nbbb", 100, 0) == ["# A\naaa\n# B\nbbb"]
    assert M.chunks("# A\naaa\n# B\nbbb", 8, 0) == ["# A\naaa", "# B\nbbb"]
    assert M.chunks("```\n# not a heading\n```\n# H\nx", 25, 0) == ["```\n# not a heading\n```", "# H\nx"]
    windows = M.chunks("x" * 1000, 300, 50)
    assert [len(w) for w in windows] == [300, 300, 300, 250]
    text = "\n".join("line %d" % k for k in range(300))
    assert all(len(c.encode()) <= 200 for c in M.chunks(text, 200, 40))
    assert set(text.split()) <= set(" ".join(M.chunks(text, 200, 40)).split())
    assert M.chunks(None) == M.chunks(" \n ") == []


def test_windows_by_hand():
    # ends of lines at 3, 7, 11, 15: the first window of 10 ends at 7 (past (10 - 4) / 2), the next starts 4 before
    assert M._windows("aaa\nbbb\nccc\nddd", 10, 4) == ["aaa\nbbb", "bbb\nccc", "ccc\nddd"]
    assert M._windows("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert M._windows("a\n" + "x" * 12, 10, 2) == ["a\n" + "x" * 8, "x" * 6]
    assert M._windows("    \n    \nyy", 5, 1) == ["yy"]


def test_only_line_feeds_end_lines():
    text = "a\x0c    b [l](u)\u2028    c [m](v)\x85\td <i>e</i>"
    assert M.searchable(text) == "a\x0c    b l\u2028    c m\x85\td e"


def test_code_chunks():
    text = "a\nb\nfunc x\n y\nfunc z\n" + "w\n" * 30
    got = M.code_chunks(text, [(5, "z"), (3, "x"), (3, "other"), (99, "gone")], 20, 6)
    assert (got[0].symbol, got[0].start_line, got[0].end_line) == ("other", 1, 4)
    assert got[1].symbol == "z" and got[1].start_line == 5
    assert all(b.start_line <= a.end_line + 1 and b.start_line > a.start_line for a, b in zip(got, got[1:]))
    assert got[-1].end_line == len(text.split("\n"))
    long_line = M.code_chunks("x" * 500, (), 100, 10)
    assert [len(c.text) for c in long_line] == [200]
    assert M.code_chunks("  \n") == M.code_chunks(None) == []


def test_images_and_rich_text():
    assert [(i.alt, i.url) for i in M.images('a ![x](u.png "t") ![y](<http://a b>) ![p](q(1).png) [no](z)')] == [("x", "u.png"), ("y", "http://a b"), ("p", "q(1).png")]
    assert M.rich_text('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"hi"},{"type":"hardBreak"},{"type":"text","text":"you"}]}]}') == "hi\nyou\n\n"
    assert M.rich_text("plain") == "plain" and M.rich_text(None) == ""


def test_html():
    title, text = M.article("<html><title>T  t</title><nav>no</nav><article><h1>H</h1><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>one<li>two</ul><script>x</script><pre>k  v</pre></article><footer>f</footer></html>", "http://h/p")
    assert title == "T t" and text == "# H\n\na **b** [l](http://h/x)\n\n- one\n- two\n\n```\nk  v\n```"
    assert M.article("<p>only</p>")[1] == "only" and M.article(None) == ("", "")


def test_summaries():
    text = "intro\n## a.py\nfirst\n===== FILE: b.py =====\nsecond\n## other\nmore"
    assert M.summary_sections(text, ["a.py", "b.py"]) == {"a.py": "first", "b.py": "second\n## other\nmore"}
    assert M.join_summaries(["x", "y"], 100) == "x\n\n---\n\ny"
    assert len(M.join_summaries(["x" * 1000] * 3, 1500)) < 1600


def test_chunk_columns(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (2, None)], "i long, t string").withColumnRenamed("i", "id")
    assert [(r.id, r.i, r.chunk) for r in M.with_chunks(df, "t").collect()] == [(1, 0, "# A\nx")]
    src = spark.createDataFrame([("f.go", "a\nfunc x\n", [(2, "x")]), ("g.go", None, [])], "path string, content string, syms array<struct<line int, name string>>")
    got = M.with_code_chunks(src, "content", "syms").collect()
    assert [(r.path, r.symbol, r.start_line) for r in got] == [("f.go", "x", 1)]


@pytest.mark.parametrize(
    ("globs_", "path", "hit"),
    [(["src/"], "src/a/b.go", True), (["**/*.go"], "a/b/c.go", True), (["**/*.go"], "c.go", True), (["*.go"], "a/b.go", True), (["a/*.go"], "a/b/c.go", False), (["a/**/z.go"], "a/z.go", True), (["[ab].go"], "a.go", True), (["[!ab].go"], "a.go", False), (["a.go"], "xa.go", False)],
)
def test_globs(spark, globs_, path, hit):
    assert one(spark, [(path,)], "p string", globs.any_glob(F.col("p"), globs_)) == [hit]


def test_selection(spark):
    paths = ["main.go", "node_modules/x.js", "docker-compose.yml", "values-prod.yaml", "notes.txt", "Dockerfile", "a_test.go", ".github/workflows/ci.yml", "random.yml", "tests/h.py", "graphify-out/g.py"]
    pick = lambda col: [p for p, ok in zip(paths, one(spark, [(p,) for p in paths], "p string", col)) if ok]
    size, usual = F.lit(10), ["main.go", "docker-compose.yml", "values-prod.yaml", "Dockerfile", "a_test.go", ".github/workflows/ci.yml", "tests/h.py"]
    assert pick(globs.selected(F.col("p"), size)) == usual
    assert pick(globs.selected(F.col("p"), size, include=["*.txt"], exclude=["notes.*"])) == []
    assert pick(globs.selected(F.col("p"), size, include=["**/*.js"])) == ["node_modules/x.js"]
    assert set(pick(globs.selected(F.col("p"), size, include_extra=["*.txt"]))) == {*usual, "notes.txt"}
    assert "tests/h.py" not in pick(globs.selected(F.col("p"), size, exclude=["tests/"]))
    assert pick(globs.selected_docs(F.col("p"))) == ["main.go", "docker-compose.yml", "values-prod.yaml", "Dockerfile", ".github/workflows/ci.yml"]
    assert pick(globs.selected_docs(F.col("p"), include=["*.go"])) == ["main.go", "a_test.go"]
    assert pick(globs.selected(F.col("p"), F.lit(1 << 20))) == []
    assert pick(globs.ignored(F.col("p"), ["node_modules", "*.yml"])) == ["node_modules/x.js", "docker-compose.yml", ".github/workflows/ci.yml", "random.yml"]


def test_clip_and_push_addresses(spark):
    texts = ["", "abcdef", "aé€😀z", "😀😀", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for limit in range(0, 12):
        for (got,), t in zip(df.select(TX.clip_utf8(F.col("t"), limit)).collect(), texts, strict=True):
            raw = (t or "").encode()
            cut = raw[:limit].decode(errors="ignore")
            want = t if t is None or not limit or len(raw) <= limit else f"{cut}\n…[truncated, {len(cut.encode())} of {len(raw)} bytes]"
            assert got == want, (t, limit)
    rows = [("nonsense", "https://u@h.example/a/b.git", "p/q", "f"), (None, "", "", "f"), ("host", None, "p/q", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, path string, name string")
    got = df.select(TX.first_repo_id([F.col("a"), F.col("b")], F.col("path"), F.col("name"))).collect()
    assert [r[0] for r in got] == ["h.example/a/b", "f", "p/q", None]
