"""DuckDB SQL of the operators that SQL can express."""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

SPHERICAL_CAPS = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v,
         coalesce(label IS NOT NULL AND len(embedding) > 0
                  AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
                  AND len([x for x in embedding if x <> 0]) > 0, false) AS sound
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS r FROM e
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON reach.a = link.a WHERE reach.r < link.b),
comp AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM e JOIN comp ON comp.a = e.vec_id
"""


def jaccard(words: int = 3, num: int = 90, den: int = 100, table: str = "documents") -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM {table}),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([{gram} for i in range(1, len(w) - {words} + 2)]) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(g) AS x FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {den} * c >= {num} * (p.n_shingles + q.n_shingles - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM n
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON reach.a = link.a WHERE reach.r < link.b),
comp AS (SELECT a, min(r) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n_shingles, comp.component_id FROM n JOIN comp ON comp.a = n.doc_id
"""


def importance(buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    """The CRC is linear: a message's is the exclusive or of each byte's, followed by zeros, and of the start value's."""
    word = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    feature = "list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    digit = "(instr('0123456789ABCDEF', x[{}]) - 1)"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {word} AS w FROM documents),
fd AS MATERIALIZED (SELECT r, unnest({feature}) AS f FROM d),
fb AS MATERIALIZED (SELECT unnest({feature}) AS f FROM (SELECT {word} AS w FROM benchmark)),
u AS MATERIALIZED (SELECT f, hex(encode(f)) AS x, strlen(f) AS n FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
byte AS MATERIALIZED (SELECT i AS b, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) s(i)),
later AS (
  SELECT b, 0 AS j, t AS c FROM byte UNION ALL SELECT 256, 0, 4294967295
  UNION ALL
  SELECT later.b, j + 1, xor(c >> 8, byte.t) FROM later JOIN byte ON byte.b = c & 255 WHERE j < (SELECT max(n) FROM u)),
place AS (SELECT f, n - i AS j, 16 * {digit.format("2 * i - 1")} + {digit.format("2 * i")} AS b FROM (SELECT f, x, n, unnest(range(1, n + 1)) AS i FROM u)),
body AS (SELECT f, bit_xor(later.c) AS c FROM place JOIN later USING (b, j) GROUP BY f),
code AS MATERIALIZED (SELECT u.f, xor(xor(body.c, later.c), 4294967295) % {buckets} AS bucket FROM u JOIN body USING (f) JOIN later ON later.b = 256 AND later.j = u.n),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN code USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN code USING (f) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM fd)::DOUBLE AS s_all, (SELECT count(*) FROM fb)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + {buckets}) / ((s + 1) * (t_all + {buckets}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket) CROSS JOIN n),
m AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS g FROM fd JOIN code USING (f) JOIN gain USING (bucket) GROUP BY r),
w AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m ON m.r = d.r),
z AS (SELECT *, weight + floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS k FROM z WHERE n_words >= {least_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN k <= (SELECT count(*) * {percent} // 100 FROM k) THEN k END AS rank
FROM z LEFT JOIN k USING (r)
"""


def divergence(least_docs: int = 30, top: int = 50) -> str:
    share = "1 + 1000000000::HUGEINT * ({} + 5) // ({} + 5 * v)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {least_docs}),
lang AS (SELECT lang, count(*) AS v, sum(n) AS n_all FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(max(v), 0) AS v, coalesce(max(n_all), 0) AS n_all, coalesce(max(x.n), 0) AS n_own
  FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN lang USING (lang)
  LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL) x ON x.lang = d.lang AND x.source = d.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {share.format("coalesce(c.n, 0)", "n_own")} AS p, {share.format("kept.n", "n_all")} AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= {top}
"""
