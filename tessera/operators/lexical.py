"""Full-text search: query grammar, BM25 over token arrays, best chunk of a document, exact paging.

The query's terms are known before the scan, so nothing is inverted: every chunk's term
frequencies are counted where its text is read, corpus statistics are one aggregate, and the
top rows are taken without a shuffle of the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN, tokens
from tessera.operators.order import numbered

K1, B = 1.2, 0.75
MAX_TERMS = 12
FREQUENT_RATIO, FREQUENT_SAMPLE, FREQUENT_CAP, FREQUENT_DRIFT = 0.35, 2000, 500, 0.25


@dataclass(frozen=True)
class Atom:
    """A term, a phrase of several words, or a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass
class Query:
    """All groups must match (any atom of each), no atom of ``without`` may."""

    groups: list[list[Atom]] = field(default_factory=list)
    without: list[Atom] = field(default_factory=list)

    @property
    def atoms(self) -> list[Atom]:
        return list(dict.fromkeys(a for g in self.groups for a in g))


_TOKEN = re.compile(TOKEN.replace(r"\p{L}\p{N}", r"^\W_"))


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def parse(query: str) -> Query:
    """AND by default; OR joins the clause before it; NOT or a leading '-' excludes; "..." and x* as usual."""
    out, negate, join = Query(), False, False
    for quoted, bare in re.findall(r'(-?"[^"]*")|(\S+)', query):
        raw = quoted or bare
        if raw == "OR":
            join = bool(out.groups)
            continue
        if raw in ("NOT", "AND"):
            negate = raw == "NOT"
            continue
        if raw.startswith("-") and len(raw) > 1:
            negate, raw = True, raw[1:]
        prefix = raw.endswith("*") and not quoted
        w = words_of(raw)
        if w:
            atom = Atom(tuple(w), prefix)
            if negate:
                out.without.append(atom)
            elif join:
                out.groups[-1].append(atom)
            else:
                out.groups.append([atom])
        negate = join = False
    return out


def has_operators(question: str) -> bool:
    """Whether the text already uses the grammar."""
    return '"' in question or any(w in ("OR", "NOT") or (w.startswith("-") and len(w) > 1) or (w.endswith("*") and len(w) > 1) for w in question.split())


def is_identifier(word: str) -> bool:
    """Any digit or joiner, or no letter at all."""
    return any(c.isdigit() or c in ".-_/+@" for c in word) or not any(c.isalpha() for c in word)


def build_query(question: str, stop: frozenset[str] = frozenset()) -> str:
    """Identifiers are required, prose is OR-ed, common words go; twelve terms at most, required ones first."""
    if has_operators(question):
        return question
    required: list[str] = []
    optional: list[str] = []
    for raw in question.split():
        word = raw.strip(".,;:!?()[]{}<>'`")
        if not word:
            continue
        kind = required if is_identifier(word) else optional
        if kind is optional and (len(word) < 2 or word.lower() in stop):
            continue
        if word.lower() not in (w.lower() for w in kind):
            kind.append(word)
    required = required[:MAX_TERMS]
    optional = optional[: MAX_TERMS - len(required)]
    parts = ([" OR ".join(optional)] if optional else []) + required
    return " ".join(parts) or question


def frequency(tok: Column, atom: Atom) -> Column:
    """How often the atom occurs in a token array."""
    w = atom.words
    if len(w) == 1:
        return F.size(F.filter(tok, lambda x: x.startswith(w[0]) if atom.prefix else x == w[0]))

    # two spaces between tokens, so that a phrase is found wherever it begins
    spaced = F.concat(F.lit(" "), F.array_join(tok, "  "), F.lit(" "))
    phrase = "  ".join(re.escape(x) for x in w) + ("[^ ]*" if atom.prefix else "")
    return F.regexp_count(spaced, F.lit(f"(?= {phrase} )"))


def matches(chunks: DataFrame, query: Query, text: str = "text") -> DataFrame:
    """Rows that satisfy the query, with ``score`` (BM25).

    Statistics are of all rows given, so filters of scope belong before. A query without
    positive clauses matches nothing.
    """
    atoms = query.atoms
    base = chunks.withColumn("_tok", tokens(F.col(text)))
    if not atoms:
        return chunks.where(F.lit(False)).withColumn("score", F.lit(0.0))
    tf = {a: f"_tf{k}" for k, a in enumerate([*atoms, *[a for a in query.without if a not in atoms]])}
    counted = base.select("*", F.size("_tok").alias("_dl"), *[frequency(F.col("_tok"), a).alias(c) for a, c in tf.items()]).drop("_tok")
    stat = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("dl"), *[F.sum((F.col(tf[a]) > 0).cast("long")).alias(tf[a]) for a in atoms]).first()
    n, mean = stat["n"], stat["dl"] or 1.0
    score = F.lit(0.0)
    for a in atoms:
        df, x = stat[tf[a]] or 0, F.col(tf[a])
        idf = F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))
        score = score + idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("_dl") / mean))
    ok = F.lit(True)
    for g in query.groups:
        any_ = F.lit(False)
        for a in g:
            any_ = any_ | (F.col(tf[a]) > 0)
        ok = ok & any_
    for a in query.without:
        ok = ok & (F.col(tf[a]) == 0)
    return counted.where(ok).select(*chunks.columns, score.alias("score"))


def best_chunks(hits: DataFrame, doc: list[str], chunk: str, top: int) -> DataFrame:
    """Each document's best chunk, the ``top`` documents by score; ties by document, then chunk."""
    score = F.round("score", 6).alias("score")
    rank = Window.partitionBy(*doc).orderBy(F.desc("score"), chunk)
    one = hits.withColumn("score", score).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    return one.orderBy(F.desc("score"), *doc).limit(top)


def page(df: DataFrame, order: list, number: int, size: int, most: int) -> tuple[DataFrame, int]:
    """Rows of one page and the exact total; past the end: no rows."""
    number, size = max(1, number), min(most, size if size > 0 else most)
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def frequent_terms(chunks: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Terms in at least 35% of a stride sample of about 2000 chunks; 500 at most, by frequency.

    The stride follows the row number in ``order``, which is counted within ranges so that
    numbering needs no single task.
    """
    total = chunks.count()
    stride = max(1, total // FREQUENT_SAMPLE)
    sampled = -(-total // stride)
    df = chunks.select(*dict.fromkeys([*order, text]))  # the text may be part of the order
    rows = numbered(df, [F.col(c).asc_nulls_last() for c in order], "_n") if stride > 1 else df.withColumn("_n", F.lit(0))
    words = rows.where(F.col("_n") % stride == 0).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    need = max(1, int(FREQUENT_RATIO * sampled))
    return words.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= need).orderBy(F.desc("df"), "term").limit(FREQUENT_CAP)


def needs_refresh(total: int, last_total: int | None) -> bool:
    """Statistics are counted anew when the corpus has drifted by a quarter."""
    return last_total is None or last_total == 0 or abs(total - last_total) >= FREQUENT_DRIFT * last_total


def matching_line(text: Column, terms: list[str], start: Column | int = 1) -> Column:
    """Number of the first line with most distinct query terms; without any, ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    scores = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.size(F.array_intersect(tokens(line), wanted)))
    top = F.array_max(scores)
    return F.when(top > 0, start + F.array_position(scores, top).cast("int") - 1).otherwise(start)
