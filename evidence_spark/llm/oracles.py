"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from evidence_spark.llm.clusters import CLUSTERS, DIMS, ROUNDS, SALT, SCALE
from evidence_spark.llm.shards import BITS, BYTE_LIMIT
from evidence_spark.llm.urlfilter import PATTERN_RULES, SITE_RULES


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_rules() -> str:
    site = ", ".join(f"({_quoted(r.name.split('/', 1)[0])}, {_quoted('/' + r.name.split('/', 1)[1])}, {_quoted(r.verdict)})" for r in SITE_RULES)
    pattern = ", ".join(f"({_quoted(r.regex)})" for r in PATTERN_RULES)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
site(h, p, verdict) AS (VALUES {site}), pattern(re) AS (VALUES {pattern}),
hits AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS r
         FROM parts JOIN site ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
blocked AS (SELECT DISTINCT page_id FROM parts JOIN pattern ON regexp_matches(host || path, re))
SELECT p.page_id, p.host, p.path, s.rule, coalesce(s.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p LEFT JOIN hits s ON p.page_id = s.page_id AND s.r = 1 LEFT JOIN blocked b ON p.page_id = b.page_id"""


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.e, d.e)::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

# The quadratic form: every pair of documents that shares a shingle, and then the smallest id within reach.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
         FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, s.s"""

EXTENDIBLE = f"""
WITH keys AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS bits FROM documents),
levels AS (SELECT k.*, d.depth::INT AS depth, bits >> ({BITS} - d.depth)::INT AS bucket FROM keys k, range(0, {BITS} + 1) d(depth)),
fits AS (SELECT depth, bucket FROM levels GROUP BY 1, 2 HAVING sum(n_bytes) <= {BYTE_LIMIT} OR count(*) = 1)
SELECT doc_id, n_bytes, depth, bucket, 0::BIGINT AS part FROM levels JOIN fits USING (depth, bucket)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""



def _clusters() -> str:
    """Rounds unrolled; every distance computed, from exact integers in doubles."""
    distance = "v.s + c.s - 2 * list_dot_product(v.e, c.e)"
    square = "list_dot_product({0}, {0}) AS s"
    parts = [f"""
WITH v AS MATERIALIZED (SELECT r, vec_id, e, {square.format('e')} FROM (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), vec_id, e) - 1 AS c, e, s FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), vec_id, e) <= {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min(({distance}, c.c)) AS best FROM v, c{i} c GROUP BY v.r)")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT c, list(x ORDER BY pos) AS e FROM (
  SELECT a.best[2] AS c, u.pos, floor(sum(v.e[u.pos]) / count(*)) AS x FROM a{i} a JOIN v USING (r), range(1, {DIMS + 1}) u(pos) GROUP BY 1, 2) GROUP BY c)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e, list_dot_product(coalesce(m.e, c.e), coalesce(m.e, c.e)) AS s FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)")
    last = f"""
SELECT v.vec_id, a.best[2]::INT AS cluster, a.best[1]::BIGINT AS distance, sum(a.best[1]) OVER (PARTITION BY a.best[2])::BIGINT AS cluster_inertia,
       sum(a.best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c ON c.c = a.best[2]"""
    return ",\n".join(parts) + last


SQL: dict[str, str] = {"op1_minhash_near_dedup": NEAR_DUPLICATES, "op4_extendible_sharding": EXTENDIBLE, "op9_url_filter": _url_rules(), "op10_exact_top_k": TOP_K,
                       "op11_centroid_clustering": _clusters()}
