"""SQL of the registered queries that DuckDB can express: the plain computation, without the operators' methods."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
_SQUARED = "CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({a}, {b})]) AS BIGINT)"
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _integers(scale: int) -> str:
    return f"[CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]"


def centroids_sql(k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64) -> str:
    steps = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, {_integers(scale)} AS v FROM embeddings "
             f"WHERE len(embedding) = {dims} AND {_FINITE})",
             f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v FROM "
             f"(SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, "
                     f"min({{'d': d, 'c': cluster}}) AS m FROM (SELECT id, vec_id, k.v, cluster, "
                     f"{_SQUARED.format(a='k.v', b='c.v')} AS d FROM kept k, c{r} c) GROUP BY id)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN ("
                         f"SELECT cluster, list({_FLOOR} ORDER BY place) AS v FROM (SELECT m.c AS cluster, place, "
                         f"sum(v[place]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(place) "
                         "GROUP BY ALL) GROUP BY cluster) m USING (cluster))")
    return ("WITH " + ", ".join(steps) + " SELECT vec_id, m.c AS cluster, m.d AS distance, "
            "CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, "
            f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.cluster = m.c")


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    width = f"CAST(len(v) / {parts} AS BIGINT)"
    steps = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, {_integers(scale)} AS v "
             f"FROM embeddings WHERE {_FINITE})",
             f"cut AS MATERIALIZED (SELECT id, vec_id, label, part, v[part * {width} + 1:(part + 1) * {width}] AS v "
             f"FROM kept, range(0, {parts}) t(part))",
             "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v "
             f"FROM cut QUALIFY entry < {entries})"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, part, any_value(vec_id) AS vec_id, any_value(label) AS label, "
                     f"any_value(v) AS v, min({{'d': d, 'c': entry}}) AS m FROM (SELECT id, vec_id, label, k.part, k.v, "
                     f"entry, {_SQUARED.format(a='k.v', b='c.v')} AS d FROM cut k JOIN c{r} c ON k.part = c.part) "
                     "GROUP BY id, part)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c "
                         f"LEFT JOIN (SELECT part, entry, list({_FLOOR} ORDER BY place) AS v FROM (SELECT part, "
                         "m.c AS entry, place, sum(x) AS s, count(*) AS n FROM (SELECT part, m, unnest(v) AS x, "
                         f"generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY part, entry) m "
                         "ON m.part = c.part AND m.entry = c.entry)")
    return ("WITH " + ", ".join(steps) + f", book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' "
            f"ORDER BY part, entry)) AS h FROM c{rounds}), coded AS (SELECT id, any_value(vec_id) AS vec_id, "
            "any_value(label) AS label, string_agg(printf('%02x', m.c), '' ORDER BY part) AS code, "
            f"CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY id) "
            "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
            "h AS codebooks_sha256 FROM coded, book")


def minhash_sql(width: int = 4, percent: int = 80) -> str:
    """Pairs from an inverted join on shingles; components by following links from every document."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+')"
    return f"""WITH RECURSIVE split AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents),
sets AS MATERIALIZED (SELECT id, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
  WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i:i + {width - 1}], ' ') FOR i IN range(1, len(w) - {width - 2})] END) AS s FROM split),
class AS MATERIALIZED (SELECT *, min(id) OVER (PARTITION BY list_sort(s)) AS c, len(s) AS n FROM sets),
one AS MATERIALIZED (SELECT c, n, unnest(s) AS x FROM class WHERE id = c AND n > 0),
pair AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM one a JOIN one b ON a.x = b.x AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT c AS a, c AS b FROM class UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
root AS (SELECT r.a AS c, min(k.doc_id) AS component_id FROM reach r JOIN class k ON k.c = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id,
  coalesce(doc_id = CASE WHEN n = 0 THEN doc_id ELSE component_id END, false) AS kept FROM class JOIN root USING (c)"""
