"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS node, b AS other FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other)
SELECT m.vec_id, coalesce(n.links, 0) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id, m.vec_id = least(m.vec_id, coalesce(c.low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN (SELECT a, count(*) AS links FROM p GROUP BY a) n ON n.a = m.vec_id LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY node) c ON c.node = m.vec_id
"""

OP6 = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, unnest(list_transform(range(1, len(words) - 18), lambda i: array_to_string(words[i : i + 19], ' '))) AS seq FROM w WHERE len(words) >= 20),
o AS (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) AS place FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM o WHERE place > 1),
x AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r AS (SELECT a AS node, b AS other FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.low, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(l.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY node) l ON l.node = w.doc_id
"""

def _op12() -> str:
    """Three rounds, each a cross of vectors with 16 centroids that is grouped again."""
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    near = "SELECT v.vec_id, v.place, min(struct_pack(d := CAST({0} AS BIGINT), c := c.c)) AS best FROM v, c{1} c GROUP BY ALL"
    parts = [
        """e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS place FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0),
v AS (SELECT vec_id, place, list_transform(embedding, lambda a: CAST(floor(64 * a::DOUBLE) AS BIGINT)) AS x FROM e),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM v ORDER BY sha256('1:' || vec_id), x LIMIT 16)"""
    ]
    for r in range(4):
        parts.append(f"a{r} AS ({near.format(apart, r)})")
        if r < 3:
            parts.append(f"""u{r} AS (SELECT best.c AS c, unnest(x) AS t, unnest(range(1, 65)) AS i FROM a{r} a JOIN v ON v.place = a.place),
s{r} AS (SELECT c, i, CAST(sum(t) AS BIGINT) AS s, count(*) AS n FROM u{r} GROUP BY c, i),
n{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN n{r} n ON n.c = o.c)""")
    return f"""WITH {", ".join(parts)},
t AS (SELECT best.c AS c, CAST(sum(best.d) AS BIGINT) AS inertia FROM a3 GROUP BY 1)
SELECT a.vec_id, a.best.c AS cluster, a.best.d AS distance, t.inertia AS cluster_inertia, (SELECT CAST(sum(inertia) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN t ON t.c = a.best.c JOIN c3 c ON c.c = a.best.c"""


OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT k.term) AS v FROM g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
m AS (SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0) AS total FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
l AS (SELECT lang, sum(total) AS total FROM m GROUP BY lang),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (m.total + 2 * m.v) AS HUGEINT) AS p FROM m JOIN k ON k.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
q AS (SELECT p.lang, p.term, CAST(1 + 1000000000::HUGEINT * (sum(p.n) + 2) // (any_value(l.total) + 2 * any_value(v.v)) AS HUGEINT) AS q FROM p JOIN l ON l.lang = p.lang JOIN v ON v.lang = p.lang GROUP BY p.lang, p.term),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum((pa.p - pb.p) * (pa.p - pb.p) // (pa.p + pb.p)), 0) AS BIGINT) AS value
 FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY ALL
 UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""

ORACLE_SQL = {"op1_embedding_near_dedup": OP1, "op6_substring_dedup": OP6, "op10_minhash_near_dedup": OP10, "op12_centroid_clusters": _op12(), "op13_source_divergence": OP13}
