"""Graph files, markdown folders and file listings as DataFrames; paths may be on any storage Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown
from tessera.functions.text import first_heading

GRAPH_MOST_BYTES, READ_MOST_BYTES, LIST_MOST = 512 << 20, 512 << 10, 2000
_GRAPH = """struct<
 nodes: array<struct<id string, label string, norm_label string, source_file string, source_location string, file_type string, community int>>,
 links: array<struct<source string, target string, relation string, confidence string, context string>>,
 edges: array<struct<source string, target string, relation string, confidence string, context string>>>"""


def _text(content: str) -> Column:
    """Bytes as UTF-8; what is none becomes replacement characters instead of stopping the job."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file: ``links``, or the older ``edges`` where there are none.

    Nodes without an id and edges to missing nodes are left out; ``ord`` is the place in the
    file. Other suffixes and files over 512 MiB are refused. One file is one graph and one row.
    """
    if not path.endswith(".json"):
        raise ValueError("a graph file must end in .json")
    file = spark.read.format("binaryFile").load(path).select("length", F.from_json(_text("content"), _GRAPH).alias("g"), _text("content").alias("raw"))
    if not file.where(F.col("length") > GRAPH_MOST_BYTES).isEmpty():
        raise ValueError("the graph file is too large")
    nodes = file.select(F.posexplode("g.nodes").alias("ord", "n")).select(F.col("ord").cast("long"), "n.*").where("id is not null and id <> ''")
    some = F.when(F.size("g.links") > 0, F.col("g.links")).otherwise(F.col("g.edges"))
    edges = file.select(F.posexplode(some).alias("ord", "e")).select(F.col("ord").cast("long"), "e.*")
    ids = nodes.select("id").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges.select("ord", "source", "target", "relation", F.coalesce(F.nullif("confidence", F.lit("")), F.lit("EXTRACTED")).alias("confidence"), "context")


def graph_faults(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a graph file; an empty graph is sound."""
    raw = spark.read.format("binaryFile").load(path).select(_text("content").alias("raw"))
    row = raw.select(F.get_json_object("raw", "$").isNull().alias("bad"), F.get_json_object("raw", "$.nodes").alias("n"), F.get_json_object("raw", "$.links").alias("l"), F.get_json_object("raw", "$.edges").alias("e"), F.from_json("raw", _GRAPH).alias("g"))
    r = row.first()
    out = []
    if r.bad:
        return ["not JSON"]
    if r.n is None:
        out.append("no nodes")
    if r.l is None and r.e is None:
        out.append("no links")
    nodes = row.select(F.explode("g.nodes.id").alias("id"))
    if not nodes.where("id is null or id = ''").isEmpty():
        out.append("a node has no id")
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        out.append("an id is repeated")
    some = F.when(F.size("g.links") > 0, F.col("g.links")).otherwise(F.col("g.edges"))
    ends = row.select(F.explode(some).alias("x")).select(F.explode(F.array("x.source", "x.target")).alias("id"))
    if not ends.join(nodes, "id", "left_anti").isEmpty():
        out.append("an edge leads to a missing node")
    return out


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of every file below a folder, repository data left out; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _literal(base.replace("file://", "")), "")
    return f.select(path.alias("path"), "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"(^|/)\.git/"))


def _literal(s: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in s)


def listing(files: DataFrame, folder: str = "", recursive: bool = False) -> DataFrame:
    """Entries below a folder, folders first, then by path, 2000 at most; generated folders left out."""
    base = folder.strip("/") + "/" if folder.strip("/") else ""
    rows = files.where(F.col("path").startswith(base)).withColumn("rest", F.substr("path", F.lit(len(base) + 1)))
    rows = rows.where(~F.col("rest").rlike(r"^(graphify-out|vendor)/") if not recursive else ~F.col("rest").rlike(r"(^|/)(graphify-out|vendor)/"))
    if recursive:
        out = rows.select("path", F.lit(False).alias("is_dir"), "length")
    else:
        top = F.split("rest", "/")
        out = rows.groupBy(F.concat(F.lit(base), top[0]).alias("path"), (F.size(top) > 1).alias("is_dir")).agg(F.max(F.when(F.size(top) == 1, F.col("length"))).alias("length"))
    return out.orderBy(F.desc("is_dir"), "path").limit(LIST_MOST)


def ranged_read(spark: SparkSession, root: str, path: str, offset: int = 0, most: int = 32 << 10) -> DataFrame:
    """Bytes of one file from ``offset`` on: (size, content, truncated). Paths may not leave the folder."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or path.startswith("/"):
        raise ValueError("not a file below the folder")
    n = min(READ_MOST_BYTES, max(1, most))
    f = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{'/'.join(parts)}")
    return f.select(F.col("length").alias("size"), F.substring("content", offset + 1, n).alias("content"), (F.lit(offset + n) < F.col("length")).alias("truncated"))


def markdown_documents(spark: SparkSession, root: str, manifest: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path, title, text) of the ``*.md`` files of a folder; title of the manifest, else the first heading, else the path.

    ``only``: paths that changed; those that are gone simply have no row.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _literal(base.replace("file://", "")), "")
    docs = f.select(path.alias("path"), _text("content").alias("text"))
    if only is not None:
        docs = docs.join(only.select("path").distinct(), "path", "left_semi")
    if manifest:
        index = spark.read.option("multiLine", "true").schema("docs array<struct<path string, title string>>").json(manifest).select(F.explode("docs").alias("d")).select("d.path", F.col("d.title").alias("known")).dropDuplicates(["path"])
        docs = docs.join(index, "path", "left")
    else:
        docs = docs.withColumn("known", F.lit(None).cast("string"))
    return docs.select("path", F.coalesce(F.nullif("known", F.lit("")), first_heading(F.col("text")), "path").alias("title"), "text")


def document_chunks(docs: DataFrame, repo: str, kind: str, size: int = markdown.LEXICAL_SIZE, overlap: int = markdown.LEXICAL_OVERLAP) -> DataFrame:
    """Chunks of documents as indexed: id ``repo/path#i``, title, and the projected text under its title."""
    shown = docs.withColumn("shown", markdown.searchable_column(F.col("text")))
    titled = markdown._udf(lambda t, x: markdown.titled(t or "", x or ""), "string")
    cut = markdown.with_chunks(shown.withColumn("shown", titled(F.col("shown"), F.col("title"))).drop("text"), "shown", size, overlap)
    return cut.select(F.concat(F.lit(repo), F.lit("/"), "path", F.lit("#"), F.col("i").cast("string")).alias("id"), F.lit(repo).alias("repo"), F.lit(kind).alias("kind"), "path", "title", F.col("chunk").alias("excerpt"))


def code_documents(spark: SparkSession, root: str, include: list[str] = (), include_extra: list[str] = (), exclude: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(path, content) of the source files to index: selected by path and size, without binaries.

    Files are listed and chosen first, and only the chosen ones are opened: the names go to the
    executors, which read each file's bytes where its row is (Spark's listing has been made).
    """
    from tessera.functions.globs import selected

    chosen = tree(spark, root).where(selected(F.col("path"), F.col("length"), list(include), list(include_extra), list(exclude)))
    if only is not None:
        chosen = chosen.join(only.select("path").distinct(), "path", "left_semi")
    base = root.rstrip("/")
    found = [f"{base}/{r.path}" for r in chosen.select("path").collect()]  # names of the files to read, as a scan's own listing is
    if not found:
        return spark.createDataFrame([], "path string, content string")
    f = spark.read.format("binaryFile").load([_glob_literal(x) for x in found])
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + _literal(base.replace("file://", "") + "/"), "")
    return f.where(~F.contains("content", F.lit(b"\x00"))).select(path.alias("path"), _text("content").alias("content"))


def _glob_literal(path: str) -> str:
    return "".join("\\" + c if c in "\\*?[]{}," else c for c in path)


def code_chunks(docs: DataFrame, repo: str, symbols: DataFrame | None = None, size: int = markdown.CODE_SIZE, overlap: int = markdown.CODE_OVERLAP) -> DataFrame:
    """Chunks of source files as indexed: id ``repo/path#i``, symbol, lines, snippet."""
    rows = docs if symbols is None else docs.join(symbols, "path", "left")
    cut = markdown.with_code_chunks(rows, "content", "symbols" if symbols is not None else None, size, overlap)
    return cut.select(F.concat(F.lit(repo), F.lit("/"), "path", F.lit("#"), F.col("i").cast("string")).alias("id"), F.lit(repo).alias("repo"), "path", "symbol", "start_line", "end_line", F.col("text").alias("snippet"))
