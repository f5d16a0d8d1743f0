"""DuckDB SQL with the result of the query of the same name."""

from __future__ import annotations

from corpusmap.functions.fixed import SOURCE_NAMES, STOPWORDS

ORACLE_SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _clean(text: str) -> str:
    return f"strip_accents(lower({text}))"


def _tokens(text: str, stop: bool) -> str:
    keep = "regexp_full_match(w, '[a-zA-Z]{4,}')" + (f" AND w NOT IN ({_STOP})" if stop else "")
    return (
        f"list_filter(string_split_regex({_clean(text)}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: {keep})"
    )


def _no_markup(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"


_TITLE = "split_part(text, chr(10), 1)"
_ABSTRACT = f"substr(text, length({_TITLE}) + 2)"
_CLUSTER = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"
_DOCS = f"""docs AS (
  SELECT doc_id AS id, {_TITLE} AS title, {_ABSTRACT} AS abstract, {_CLUSTER} AS cluster,
         (n_chars % 1000) / 10.0 AS x, (doc_id * 7919 % 1000) / 10.0 AS y,
         2000 + doc_id % 25 AS year,
         CASE doc_id % 4 WHEN 0 THEN 'openalex' WHEN 1 THEN 'unam_repository'
              WHEN 2 THEN 'scielo_mexico' ELSE 'src' END AS source
  FROM documents)"""
_TERMS = f"""{_DOCS},
words AS (
  SELECT cluster, id, unnest({_tokens(_no_markup("title || ' ' || abstract"), True)}) AS term
  FROM docs),
tf AS (SELECT cluster, id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT cluster, count(*) AS n_docs FROM docs GROUP BY cluster),
stats AS (
  SELECT t.cluster, t.term, count(*) AS df, sum(tf)::BIGINT AS total_tf, any_value(n_docs) AS n_docs
  FROM tf t JOIN sizes s ON t.cluster = s.cluster GROUP BY t.cluster, t.term)"""
_WEIGHTS = f"""{_TERMS},
vocab AS (
  SELECT cluster, term, ln((1.0 + n_docs) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total_tf DESC, term) AS rn
    FROM stats WHERE df <= 0.8::DOUBLE * n_docs) WHERE rn <= 1000),
raw AS (
  SELECT t.cluster, t.id, t.term, tf * idf AS w
  FROM tf t JOIN vocab v ON t.cluster = v.cluster AND t.term = v.term),
weights AS (
  SELECT cluster, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw),
scores AS (
  SELECT cluster, term, round(sum(weight), 9) AS score FROM weights GROUP BY cluster, term)"""
_CAP = "upper(left(term, 1)) || lower(substr(term, 2))"
_TOPICS = f"""{_WEIGHTS},
best AS (
  SELECT cluster, list({_CAP} ORDER BY rn) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rn
    FROM scores WHERE score > 0) WHERE rn <= 5 GROUP BY cluster),
topics AS (
  SELECT d.cluster, coalesce(any_value(keywords), ['Unknown']) AS keywords,
         avg(x) AS x, avg(y) AS y, count(*) AS count
  FROM docs d LEFT JOIN best b ON d.cluster = b.cluster GROUP BY d.cluster)"""

# Text and scalar functions

ORACLE_SQL["strip_markup"] = f"""
SELECT page_id, length(t) AS n, md5(t) AS hash FROM (
  SELECT page_id, {_no_markup('html')} AS t FROM pages)"""


def _without(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'gi')"
    return text


_JATS = ("&lt;/?title&gt;", "</?title>", "&lt;/?jats:[a-z]+&gt;", "</?jats:[a-z]+>")
ORACLE_SQL["strip_jats"] = f"""
SELECT page_id, length(t) AS n, md5(t) AS hash FROM (
  SELECT page_id, {_without('html', *_JATS)} AS t FROM pages)"""
ORACLE_SQL["truncate_text"] = """
SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END AS short
FROM documents"""
ORACLE_SQL["embedding_text"] = """
SELECT doc_id, length(t) AS n, md5(t) AS hash FROM (
  SELECT d.doc_id, coalesce(CASE WHEN quality IS NOT NULL THEN lang END, '') || '. '
         || coalesce(text, '') AS t
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ORACLE_SQL["normalize_text"] = f"""
SELECT doc_id, length(t) AS n, md5(t) AS hash FROM (
  SELECT doc_id, {_clean('text')} AS t FROM documents)"""
ORACLE_SQL["tokenize"] = f"""
SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS hash FROM (
  SELECT doc_id, {_tokens('text', False)} AS w FROM documents)"""
ORACLE_SQL["label_words"] = f"""
SELECT page_id, len(w) AS n, md5(array_to_string(w, ' ')) AS hash FROM (
  SELECT page_id, {_tokens(_no_markup("' ' || html"), True)} AS w FROM pages)"""
ORACLE_SQL["abstract_rebuild"] = r"""
SELECT doc_id, length(t) AS n, md5(t) AS hash FROM (
  SELECT doc_id, array_to_string(
    list_filter(string_split_regex(text, '[ \n\t]+'), lambda w: w <> ''), ' ') AS t
  FROM documents)"""
ORACLE_SQL["short_id"] = """
SELECT page_id, split_part(url, '/', -1) AS short FROM pages"""
ORACLE_SQL["nan_to_null"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events"""
ORACLE_SQL["downcast"] = """
SELECT l_orderkey::INTEGER AS l_orderkey, l_partkey::INTEGER AS l_partkey, l_linenumber, l_quantity
FROM lineitem"""
ORACLE_SQL["minmax_scale"] = """
SELECT c_custkey, round((c_acctbal - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled
FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"""
ORACLE_SQL["json_rows"] = "SELECT * FROM customer"

# Records

_WORKS = """institutions AS (
  SELECT l_orderkey, l_linenumber, s_suppkey, s_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 10),
records AS (
  SELECT 'https://work.example/W' || o_orderkey AS id, 'Order ' || o_orderkey AS title,
         year(o_orderdate) AS year,
         coalesce((SELECT arg_min(s_name, (l_linenumber, s_suppkey::VARCHAR)) FROM institutions
                   WHERE l_orderkey = o_orderkey), '') AS faculty,
         o_orderstatus || ' ' || o_orderpriority || ' ' || o_orderstatus AS abstract,
         'openalex' AS source,
         CASE o_orderkey % 3 WHEN 2 THEN 'https://landing.example/' || o_orderkey
              ELSE 'https://work.example/W' || o_orderkey END AS url,
         o_orderkey
  FROM orders)"""
ORACLE_SQL["flatten_works"] = f"WITH {_WORKS} SELECT * EXCLUDE (o_orderkey) FROM records"
_AT_R3 = "o_orderkey IN (SELECT l_orderkey FROM institutions WHERE s_suppkey = 3)"
ORACLE_SQL["filter_institution"] = f"""
WITH {_WORKS} SELECT id, title AS display_name FROM records WHERE {_AT_R3}"""
ORACLE_SQL["build_records"] = f"""
WITH {_WORKS} SELECT * EXCLUDE (o_orderkey) FROM records WHERE {_AT_R3}
ORDER BY year DESC NULLS LAST, id LIMIT 100"""
_BATCHES = """batches AS (
  SELECT o_orderkey AS id, year(o_orderdate) AS year, o_orderstatus AS status, o_totalprice AS price
  FROM orders UNION ALL
  SELECT o_custkey, year(o_orderdate), o_orderstatus, o_totalprice FROM orders),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY id ORDER BY year DESC NULLS LAST, status, price) AS rn FROM batches)
  WHERE rn = 1)"""
ORACLE_SQL["dedupe_latest"] = f"WITH {_BATCHES} SELECT * FROM latest"
ORACLE_SQL["cap_recent"] = """
SELECT o_orderkey AS id, year(o_orderdate) AS year, o_orderpriority FROM orders
ORDER BY year DESC NULLS LAST, id LIMIT 500"""
ORACLE_SQL["union_batches"] = """
SELECT id, count(*) AS n FROM (
  SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY id"""
ORACLE_SQL["row_count"] = "SELECT count(*) AS n FROM lineitem"
ORACLE_SQL["ingest_summary"] = f"""
WITH {_BATCHES}
SELECT r AS reported, c AS collected, r - c AS dropped, ceil(c / 5000)::BIGINT AS batches
FROM (SELECT count(*) AS r FROM batches), (SELECT count(*) AS c FROM latest)"""
_DIRECTORY = f"""{_WORKS},
directory AS (
  SELECT 'https://inst.example/I' || s_suppkey AS id, any_value(s_name) AS display_name,
         'https://ror.org/R' || s_suppkey AS external_id,
         count(DISTINCT l_orderkey) AS works_count
  FROM institutions GROUP BY s_suppkey)"""
ORACLE_SQL["institution_directory"] = f"WITH {_DIRECTORY} SELECT * FROM directory"
ORACLE_SQL["search_institutions"] = f"""
WITH {_DIRECTORY} SELECT * FROM directory
WHERE lower(display_name) LIKE 'supplier#00000000%' OR lower(display_name) LIKE '% supplier#00000000%'
ORDER BY works_count DESC, id LIMIT 5"""
ORACLE_SQL["search_entities"] = """
SELECT * FROM (
  SELECT 'institution' AS kind, s_suppkey AS id, s_name AS display_name, count(*) AS works_count
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL
  UNION ALL
  SELECT 'source', c_custkey, c_name, count(*)
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL
  UNION ALL
  SELECT 'work', p_partkey, p_name, count(*)
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
WHERE lower(display_name) LIKE 'ri%' OR lower(display_name) LIKE '% ri%'
ORDER BY works_count DESC, kind, id LIMIT 20"""
ORACLE_SQL["search_index"] = ORACLE_SQL["search_entities"]
ORACLE_SQL["sample_points"] = """
SELECT o_orderkey AS id, o_orderstatus FROM orders
ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 1000"""
ORACLE_SQL["stream_records"] = """
SELECT id, seen_at, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, event_type, value) AS rn FROM (
    SELECT user_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen_at, event_type, value
    FROM events)) WHERE rn = 1"""

# Topics

ORACLE_SQL["term_stats"] = f"WITH {_TERMS} SELECT * FROM stats"
ORACLE_SQL["tfidf_by_group"] = f"""
WITH {_WEIGHTS} SELECT cluster, term, round(score, 6) AS score FROM scores"""
ORACLE_SQL["cluster_topics"] = f"""
WITH {_TOPICS}
SELECT cluster, keywords[1] AS label, array_to_string(keywords, ' ') AS keywords,
       round(x, 6) AS x, round(y, 6) AS y, count FROM topics"""
ORACLE_SQL["build_topics"] = f"""
WITH {_TOPICS}
SELECT cluster, keywords[1] AS label, array_to_string(keywords, ' ') AS keywords, count
FROM topics"""
_FIRST_NEW = "list_filter(s.keywords, lambda w: NOT list_contains(p.used, w))[1]"


def _sub_labels(sub_of: str, middles: str) -> str:
    """Sub-topic words given the sub-cluster of each document and the centre of each."""
    return f"""{middles},
sub_scores AS (
  SELECT w.cluster, sub, term, round(sum(weight), 9) AS score
  FROM weights w JOIN ({sub_of}) o ON w.id = o.id GROUP BY ALL),
sub_best AS (
  SELECT cluster, sub, list({_CAP} ORDER BY rn) AS keywords FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster, sub ORDER BY score DESC, term) AS rn
    FROM sub_scores WHERE score > 0) WHERE rn <= 3 GROUP BY cluster, sub),
picks AS (
  SELECT cluster, -1::BIGINT AS sub, keywords[1] AS text, [keywords[1]] AS used FROM topics
  UNION ALL
  SELECT p.cluster, p.sub + 1, {_FIRST_NEW},
         CASE WHEN {_FIRST_NEW} IS NULL THEN p.used ELSE list_append(p.used, {_FIRST_NEW}) END
  FROM picks p LEFT JOIN sub_best s ON s.cluster = p.cluster AND s.sub = p.sub + 1
  WHERE p.sub < 2)
SELECT cluster, keywords[1] AS text, round(x, 6) AS x, round(y, 6) AS y, 1 AS level FROM topics
UNION ALL
SELECT p.cluster, p.text, round(m.x, 6), round(m.y, 6), 2
FROM picks p JOIN middles m ON m.cluster = p.cluster AND m.sub = p.sub WHERE p.text IS NOT NULL"""


_THIRDS = """middles AS (
  SELECT cluster, id % 3 AS sub, avg(x) AS x, avg(y) AS y FROM docs GROUP BY ALL)"""
ORACLE_SQL["sublabels"] = f"""
WITH RECURSIVE {_TOPICS}, {_sub_labels("SELECT id, id % 3 AS sub FROM docs", _THIRDS)}"""

_D2 = "((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))"
_KEY = "md5('42|' || p.id)"


def _farthest(name: str, chosen: str) -> str:
    return f"""{name} AS (
  SELECT cluster, arg_min(x, (-gap, key, id)) AS x, arg_min(y, (-gap, key, id)) AS y FROM (
    SELECT p.cluster, p.x, p.y, p.id, {_KEY} AS key, min({_D2}) AS gap
    FROM points p JOIN ({chosen}) c ON p.cluster = c.cluster GROUP BY ALL)
  WHERE gap > 0 GROUP BY cluster)"""


_C12 = "SELECT cluster, 0 AS sub, x, y FROM c1 UNION ALL SELECT cluster, 1, x, y FROM c2"


def _nearest(centres: str) -> str:
    return f"""SELECT * FROM (
    SELECT p.id, p.cluster, p.x, p.y, c.sub,
           row_number() OVER (PARTITION BY p.id ORDER BY {_D2}, c.sub) AS rn
    FROM points p JOIN {centres} c ON p.cluster = c.cluster) WHERE rn = 1"""


_KMEANS_START = f"""c1 AS (
  SELECT cluster, arg_min(x, ({_KEY}, id)) AS x, arg_min(y, ({_KEY}, id)) AS y
  FROM points p GROUP BY cluster),
{_farthest('c2', 'SELECT * FROM c1')},
{_farthest('c3', _C12)},
centres AS ({_C12} UNION ALL SELECT cluster, 2, x, y FROM c3)"""
_KMEANS_STEP = f"""{_KMEANS_START},
moved AS (
  SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY x, y) - 1 AS sub, x, y FROM (
    SELECT cluster, sub, avg(x) AS x, avg(y) AS y FROM ({_nearest('centres')})
    GROUP BY cluster, sub))"""
_TO_EACH = "list_transform(l.spots, lambda c: (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))"
# Rounds until the centres of a group rest.
_KMEANS = f"""{_KMEANS_START},
rounds AS (
  SELECT 0 AS turn, cluster, list({{'x': x, 'y': y}} ORDER BY sub) AS spots,
         NULL::STRUCT(x DOUBLE, y DOUBLE)[] AS before FROM centres GROUP BY cluster
  UNION ALL
  SELECT turn + 1, cluster, list({{'x': x, 'y': y}} ORDER BY x, y), any_value(spots) FROM (
    SELECT turn, cluster, sub, any_value(spots) AS spots, avg(x) AS x, avg(y) AS y FROM (
      SELECT l.turn, l.cluster, l.spots, p.x, p.y, list_position({_TO_EACH}, list_min({_TO_EACH})) AS sub
      FROM rounds l JOIN points p ON p.cluster = l.cluster WHERE l.before IS NULL OR l.spots <> l.before)
    GROUP BY turn, cluster, sub)
  GROUP BY turn, cluster),
moved AS (
  SELECT cluster, sub, spots[sub + 1].x AS x, spots[sub + 1].y AS y FROM (
    SELECT cluster, spots, unnest(range(len(spots))) AS sub FROM (
      SELECT cluster, arg_max(spots, turn) AS spots FROM rounds GROUP BY cluster)))"""
_LARGE = """points AS (
  SELECT id, cluster, x, y FROM docs WHERE cluster IN (
    SELECT cluster FROM topics WHERE count > 50 AND len(keywords) > 1))"""
_MOVED = "middles AS (SELECT * FROM moved)"
ORACLE_SQL["build_labels"] = f"""
WITH RECURSIVE {_TOPICS}, {_LARGE}, {_KMEANS},
{_sub_labels(_nearest('moved'), _MOVED)}"""

# Vectors

ORACLE_SQL["mean_pool"] = """
WITH long AS (
  SELECT label AS id, vec_id % 2 AS mask, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v
  FROM embeddings)
SELECT id, pos, round(sum(v * mask) / greatest(sum(mask), 1e-9), 6) AS value
FROM long GROUP BY id, pos"""
ORACLE_SQL["l2_normalize"] = """
WITH long AS (
  SELECT vec_id AS id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE * 3 AS v FROM embeddings)
SELECT id, pos, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12), 6) AS value
FROM long"""
_UNIT = """unit AS (
  SELECT vec_id AS id, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) AS e
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""
ORACLE_SQL["knn_exact"] = f"""
WITH {_UNIT},
pairs AS (
  SELECT a.id AS src, b.id AS dst,
         round(greatest(1 - list_dot_product(a.e, b.e), 0), 12) AS distance
  FROM unit a JOIN unit b ON a.id <> b.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs)
SELECT src, dst, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 5"""
_POINTS = """points AS (
  SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
         CASE label WHEN 0 THEN -1 ELSE label END AS cluster
  FROM embeddings)"""
_GAP = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def _core(k: int) -> str:
    return f"""{_POINTS},
gaps AS (
  SELECT a.id, {_GAP} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_GAP}) AS rn
  FROM points a JOIN points b ON a.id <> b.id),
cored AS (
  SELECT p.id, x, y, d AS core FROM gaps g JOIN points p ON g.id = p.id WHERE rn = {k})"""


ORACLE_SQL["core_distance"] = f"WITH {_core(10)} SELECT id, round(core, 6) AS core FROM cored"
ORACLE_SQL["connected_components"] = """
SELECT o_orderkey AS node, o_orderkey - o_orderkey % 50 AS component FROM orders
WHERE o_orderkey - o_orderkey % 50 + 1 <= (SELECT max(o_orderkey) FROM orders)"""
ORACLE_SQL["dbscan_level"] = f"""
WITH RECURSIVE {_core(5)},
levels AS (SELECT 1 AS level, 0.02::DOUBLE AS eps UNION ALL SELECT 2, 0.01::DOUBLE),
dense AS (SELECT level, eps, id, x, y FROM cored, levels WHERE core <= eps),
edges AS (
  SELECT a.level, a.id AS src, b.id AS dst FROM dense a JOIN dense b
  ON a.level = b.level AND {_GAP} <= a.eps),
reach AS (
  SELECT level, src AS id, src AS root FROM edges
  UNION SELECT e.level, e.dst, r.root FROM reach r JOIN edges e ON e.level = r.level AND e.src = r.id),
named AS (SELECT level, id, min(root) AS component FROM reach GROUP BY level, id)
SELECT level, id, component FROM (
  SELECT *, count(*) OVER (PARTITION BY level, component) AS size FROM named) WHERE size >= 3"""
ORACLE_SQL["grouped_kmeans_step"] = f"""
WITH {_POINTS}, {_KMEANS_STEP}
SELECT cluster, sub, round(x, 6) AS x, round(y, 6) AS y FROM moved"""

ORACLE_SQL["grouped_kmeans"] = f"""
WITH RECURSIVE {_POINTS}, {_KMEANS} SELECT id, cluster, sub FROM ({_nearest('moved')})"""

# Self-organizing map

_SOM = """book AS (
  SELECT som_x, som_y, list(v ORDER BY pos) AS w FROM (
    SELECT label AS som_x, vec_id % 4 AS som_y, pos, avg(v) AS v FROM (
      SELECT label, vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
    GROUP BY ALL)
  GROUP BY som_x, som_y),
assigned AS (
  SELECT id, som_x, som_y, error FROM (
    SELECT vec_id AS id, som_x, som_y, list_distance(embedding::DOUBLE[], w) AS error,
           row_number() OVER (
             PARTITION BY vec_id
             ORDER BY list_distance(embedding::DOUBLE[], w), som_x, som_y) AS rn
    FROM embeddings, book) WHERE rn = 1),
sums AS (
  SELECT a.som_x, a.som_y, sum(list_distance(a.w, b.w)) AS total
  FROM book a JOIN book b
  ON abs(a.som_x - b.som_x) <= 1 AND abs(a.som_y - b.som_y) <= 1
     AND (a.som_x, a.som_y) <> (b.som_x, b.som_y)
  GROUP BY a.som_x, a.som_y),
umatrix AS (
  SELECT som_x, som_y, round(total / max(total) OVER (), 4) AS distance FROM sums),
density AS (
  SELECT b.som_x, b.som_y, count(a.id) AS density
  FROM book b LEFT JOIN assigned a ON a.som_x = b.som_x AND a.som_y = b.som_y
  GROUP BY b.som_x, b.som_y)"""
_RECORDS = """records AS (
  SELECT vec_id AS id, 'Vector ' || vec_id AS title, (2000 + vec_id % 25)::INTEGER AS year
  FROM embeddings)"""
_SHOWN = f"""{_RECORDS}, {_SOM},
shown AS (
  SELECT s.id, som_x, som_y, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, title, year
  FROM (SELECT * FROM records ORDER BY md5('42|' || id), id LIMIT 5000) s
  JOIN assigned a ON s.id = a.id JOIN embeddings e ON e.vec_id = s.id)"""
ORACLE_SQL["som_assign"] = f"""
WITH {_SOM} SELECT id, som_x, som_y, round(error, 6) AS error FROM assigned"""
ORACLE_SQL["som_umatrix"] = f"WITH {_SOM} SELECT * FROM umatrix"
ORACLE_SQL["som_density"] = f"WITH {_SOM} SELECT * FROM density"
ORACLE_SQL["som_points_with_cluster"] = f"WITH {_SHOWN} SELECT * FROM shown"
ORACLE_SQL["som_cell_details"] = f"""
WITH {_SHOWN},
firsts AS (
  SELECT *, row_number() OVER (
    PARTITION BY som_x, som_y ORDER BY md5('42|' || id), id) AS rn FROM shown)
SELECT u.som_x, u.som_y, distance, density, title, year, cluster
FROM umatrix u JOIN density d ON u.som_x = d.som_x AND u.som_y = d.som_y
LEFT JOIN firsts f ON f.som_x = u.som_x AND f.som_y = u.som_y AND rn = 1"""

# Tiles and views


def _tiles(capacity: int, depth: int) -> str:
    parts = [
        _POINTS,
        "edges AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points)",
        "rest0 AS (SELECT id, x, y, md5('42|' || id) AS priority FROM points)",
    ]
    for z in range(depth + 1):
        cells = 2**z

        def cell(axis: str) -> str:
            share = f"({axis} - {axis}0) / ({axis}1 - {axis}0)"
            return f"least(floor({share} * {cells}), {cells - 1})::BIGINT"

        limit = "" if z == depth else f"WHERE rn <= {capacity}"
        parts.append(
            f"""ranked{z} AS (
  SELECT *, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY priority, id) AS rn FROM (
    SELECT id, x, y, priority, {cell('x')} AS tile_x, {cell('y')} AS tile_y FROM rest{z}, edges)),
kept{z} AS (SELECT id, x, y, priority, {z} AS z, tile_x, tile_y FROM ranked{z} {limit}),
rest{z + 1} AS (SELECT id, x, y, priority FROM ranked{z} WHERE rn > {capacity})"""
        )
    union = " UNION ALL ".join(f"SELECT * FROM kept{z}" for z in range(depth + 1))
    parts.append(f"tiles AS ({union})")
    parts.append(
        """manifest AS (
  SELECT z, tile_x, tile_y, z || '/' || tile_x || '/' || tile_y AS key, count(*) AS n_points,
         min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max
  FROM tiles GROUP BY ALL),
children AS (
  SELECT z - 1 AS z, tile_x // 2 AS tile_x, tile_y // 2 AS tile_y,
         list(key ORDER BY tile_x % 2 + 2 * (tile_y % 2)) AS found
  FROM manifest WHERE z > 0 GROUP BY z - 1, tile_x // 2, tile_y // 2)"""
    )
    return ",\n".join(parts)


_TILES = _tiles(50, 8)
ORACLE_SQL["quadtree_tiles"] = f"WITH {_TILES} SELECT id, z, tile_x, tile_y FROM tiles"
_ON_TILE = "m.z = c.z AND m.tile_x = c.tile_x AND m.tile_y = c.tile_y"
ORACLE_SQL["tile_manifest"] = f"""
WITH {_TILES}
SELECT key, n_points, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max,
       round(y_min, 6) AS y_min, round(y_max, 6) AS y_max,
       coalesce(array_to_string(found, ' '), '') AS children
FROM manifest m LEFT JOIN children c ON {_ON_TILE}"""
ORACLE_SQL["build_tiles"] = f"""
WITH {_TILES}
SELECT t.id::INTEGER AS id, p.cluster, m.key, coalesce(len(c.found), 0) AS n_children
FROM tiles t JOIN points p ON t.id = p.id
JOIN manifest m ON m.z = t.z AND m.tile_x = t.tile_x AND m.tile_y = t.tile_y
LEFT JOIN children c ON {_ON_TILE}"""
ORACLE_SQL["points_in_view"] = f"""
WITH {_TILES}
SELECT id, z, tile_x, tile_y FROM tiles
WHERE z <= 1 AND x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.1 AND 0.15
ORDER BY z, priority, id LIMIT 60"""
_LABELS = f"""{_POINTS},
map_labels AS (
  SELECT cluster, 'L' || id AS text, x, y, id % 2 + 1 AS level, id * 37 % 101 AS count FROM points)"""
ORACLE_SQL["labels_in_view"] = f"""
WITH {_LABELS} SELECT cluster, text, level FROM map_labels
WHERE level <= 1 AND x > -0.11 AND x < 0.16 AND y > -0.12 AND y < 0.17"""
ORACLE_SQL["declutter_labels"] = f"""
WITH RECURSIVE {_LABELS},
turns AS (
  SELECT *, x * 2000 AS px, y * 2000 AS py,
         row_number() OVER (ORDER BY level, -count, cluster, text, x, y) AS turn FROM map_labels),
greedy AS (
  SELECT 0::BIGINT AS turn, []::STRUCT(turn BIGINT, px DOUBLE, py DOUBLE)[] AS kept
  UNION ALL
  SELECT t.turn,
         CASE WHEN len(list_filter(g.kept, lambda k: abs(k.px - t.px) < 60
                                                     AND abs(k.py - t.py) < 36)) > 0
              THEN g.kept
              ELSE list_append(g.kept, {{'turn': t.turn, 'px': t.px, 'py': t.py}}) END
  FROM greedy g JOIN turns t ON t.turn = g.turn + 1),
final AS (SELECT unnest(arg_max(kept, turn)).turn AS turn FROM greedy)
SELECT cluster, text, level FROM turns JOIN final USING (turn)"""
ORACLE_SQL["cluster_census"] = f"""
WITH {_POINTS}
SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS clusters,
       count(*) FILTER (cluster = -1) AS noise, count(*) AS total FROM points"""
_SUMMARY = f"""{_POINTS},
summary AS (
  SELECT cluster, avg(x) AS x, avg(y) AS y, count(*) AS count
  FROM points WHERE cluster <> -1 GROUP BY cluster)"""
ORACLE_SQL["cluster_summary"] = f"""
WITH {_SUMMARY} SELECT cluster, round(x, 6) AS x, round(y, 6) AS y, count FROM summary"""
ORACLE_SQL["order_clusters"] = f"""
WITH {_SUMMARY} SELECT cluster, count FROM summary"""
ORACLE_SQL["filter_cluster"] = f"""
WITH {_POINTS} SELECT id, cluster FROM points WHERE cluster = 3"""
ORACLE_SQL["dataset_stats"] = f"""
WITH {_POINTS}
SELECT count(*) FILTER (cluster <> -1) AS documents, count(*) FILTER (cluster = -1) AS noise,
       count(*) AS total, count(DISTINCT cluster) FILTER (cluster <> -1) AS topics FROM points"""
ORACLE_SQL["check_aligned"] = """
SELECT doc_id AS id, 'left' AS side FROM documents
WHERE doc_id NOT IN (SELECT doc_id * 2 FROM labels)
UNION ALL
SELECT doc_id * 2, 'right' FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)"""
ORACLE_SQL["attach_layout"] = f"""
WITH {_DOCS}, {_POINTS},
placed AS (
  SELECT id, x, y, cluster FROM points
  UNION ALL
  SELECT id, x, y, cluster FROM docs d WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.id = d.id))
SELECT d.id, title, round(l.x, 6) AS x, round(l.y, 6) AS y, c.cluster
FROM docs d JOIN placed l ON d.id = l.id JOIN placed c ON d.id = c.id"""
_NAMED = """topics AS (
  SELECT cluster, 'Topic ' || cluster AS label FROM points
  WHERE cluster <> -1 GROUP BY cluster HAVING avg(x) > 0)"""
ORACLE_SQL["attach_topic"] = f"""
WITH {_POINTS}, {_NAMED}
SELECT id, p.cluster, coalesce(label, 'Cluster ' || p.cluster) AS topic
FROM points p LEFT JOIN topics t ON p.cluster = t.cluster"""
_SOURCE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_NAMES.items())
ORACLE_SQL["point_details"] = f"""
WITH {_DOCS}, {_POINTS}, {_NAMED},
shown AS (
  SELECT d.* EXCLUDE (cluster), coalesce(p.cluster, 0) AS cluster
  FROM docs d LEFT JOIN points p ON d.id = p.id)
SELECT id,
       CASE WHEN id % 5 = 0 OR title = '' THEN 'Untitled'
            ELSE {_without('title', *_JATS)} END AS title,
       year::VARCHAR AS year,
       CASE WHEN id % 2 = 0 THEN source ELSE '' END AS faculty,
       {_without("CASE WHEN length(abstract) > 500 THEN left(abstract, 500) || '…' ELSE abstract END", *_JATS)}
         AS abstract,
       '' AS url, CASE source {_SOURCE_CASES} ELSE source END AS source,
       coalesce(label, 'Cluster ' || s.cluster) AS topic
FROM shown s LEFT JOIN topics t ON s.cluster = t.cluster"""
ORACLE_SQL["available_datasets"] = """
WITH sets AS (
  SELECT o_custkey AS inst_id, o_orderpriority, o_totalprice,
         CASE o_orderstatus WHEN 'F' THEN 'full' ELSE 'limited' END AS mode FROM orders),
ready AS (
  SELECT DISTINCT inst_id, mode FROM sets s WHERE o_orderpriority = '1-URGENT' AND EXISTS (
    SELECT 1 FROM sets t WHERE t.o_totalprice > 400000
      AND t.inst_id = s.inst_id AND t.mode = s.mode))
SELECT inst_id, array_to_string(list(mode ORDER BY mode), ' ') AS modes FROM ready GROUP BY inst_id"""

# Stored tables

ORACLE_SQL["read_works"] = f"""
WITH {_WORKS} SELECT id, title AS text FROM records
UNION ALL SELECT NULL, '{{"id": ' || r_regionkey FROM region"""
ORACLE_SQL["write_records"] = ORACLE_SQL["flatten_works"]
ORACLE_SQL["merge_batches"] = ORACLE_SQL["flatten_works"]
ORACLE_SQL["embeddings_store"] = """
SELECT vec_id::VARCHAR AS id, len(embedding) AS n,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"""
ORACLE_SQL["map_points_roundtrip"] = f"""
WITH {_DOCS}
SELECT CASE id % 3 WHEN 0 THEN '02e463172' WHEN 1 THEN '04e456789' ELSE '0123' END AS inst_id,
       id::VARCHAR AS id, title, cluster, round(x, 6) AS x, round(y, 6) AS y FROM docs"""
ORACLE_SQL["som_store"] = f"""
WITH {_SOM}
SELECT u.som_x, u.som_y, distance, density
FROM umatrix u JOIN density d ON u.som_x = d.som_x AND u.som_y = d.som_y"""
ORACLE_SQL["tiles_store"] = ORACLE_SQL["quadtree_tiles"]
ORACLE_SQL["labels_store"] = f"""
WITH {_POINTS}
SELECT CASE label WHEN 0 THEN -1 ELSE label END AS cluster, 'L' || vec_id AS text,
       round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y,
       (vec_id % 2 + 1)::INTEGER AS level FROM embeddings"""
ORACLE_SQL["has_rows"] = """
SELECT s AS status, EXISTS (FROM orders WHERE o_orderstatus = s AND o_totalprice > 0) AS some
FROM (VALUES ('F'), ('O'), ('?')) v(s)"""

# Embedding, neighbours and graph weights


def _embedded(rows: str) -> str:
    """Signed projection of the TF-IDF weights of ``rows`` (id, text) on 64 dimensions."""
    return f"""
WITH {rows},
words AS (
  SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                                lambda w: w <> '')) AS term FROM texts),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
idf AS (
  SELECT term, ln(((SELECT count(*) FROM texts) + 1) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
signs AS (
  SELECT term, idf, d, 2 * ((('0x' || substr(md5('42|0|' || term), 1 + 8 * (d // 32)::INT, 8))::BIGINT
         >> (d % 32)::INT) & 1) - 1 AS sign
  FROM idf, range(64) r(d) WHERE idf > 0),
sums AS (
  SELECT id, d, sum(tf * idf * sign) AS total FROM tf JOIN signs USING (term) GROUP BY id, d),
lengths AS (SELECT id, sqrt(sum(total * total)) AS norm FROM sums GROUP BY id)
SELECT t.id, r.d::INT AS pos, round(coalesce(total / greatest(norm, 1e-12), 0)::FLOAT::DOUBLE, 6) AS value
FROM texts t CROSS JOIN range(64) r(d) LEFT JOIN sums s ON s.id = t.id AND s.d = r.d
LEFT JOIN lengths l ON l.id = t.id"""


ORACLE_SQL["embed_text"] = _embedded("texts AS (SELECT doc_id AS id, text FROM documents)")
ORACLE_SQL["build_embeddings"] = _embedded(
    f"{_DOCS}, texts AS (SELECT id, coalesce(title, '') || '. ' || coalesce(abstract, '') AS text FROM docs)"
)
ORACLE_SQL["fuzzy_graph"] = f"""
WITH RECURSIVE {_UNIT},
pairs AS (
  SELECT a.id AS src, b.id AS dst,
         round(greatest(1 - list_dot_product(a.e, b.e), 0), 12) AS distance
  FROM unit a JOIN unit b ON a.id <> b.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs),
near AS (
  SELECT src, list(distance) AS ds, list(dst) AS ids,
         coalesce(min(distance) FILTER (distance > 0), 0) AS rho, avg(distance) AS mean
  FROM ranked WHERE rank <= 14 GROUP BY src),
halved AS (
  SELECT src, list_transform(ds, lambda d: greatest(d - rho, 0)) AS beyond, 0 AS turn,
         0.0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1.0::DOUBLE AS sigma FROM near
  UNION ALL
  SELECT src, beyond, turn + 1, low_, high_,
         CASE WHEN isinf(high_) THEN sigma * 2 ELSE (low_ + high_) / 2 END
  FROM (
    SELECT *, CASE WHEN above THEN low ELSE sigma END AS low_,
           CASE WHEN above THEN sigma ELSE high END AS high_
    FROM (SELECT *, list_sum(list_transform(beyond, lambda o: exp(-o / sigma))) > log2(15) AS above
          FROM halved WHERE turn < 64))),
weights AS (
  SELECT n.src, unnest(n.ids) AS dst,
         unnest(list_transform(h.beyond,
                lambda o: exp(-o / greatest(h.sigma, 1e-3 * greatest(n.mean, 1e-12))))) AS w
  FROM near n JOIN halved h ON h.src = n.src AND h.turn = 64),
both_ways AS (SELECT src, dst, w FROM weights UNION ALL SELECT dst, src, w FROM weights)
SELECT src, dst,
       round(sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END, 6) AS weight
FROM both_ways GROUP BY src, dst"""
ORACLE_SQL["knn_ivf"] = f"""
WITH {_UNIT},
pivots AS (
  SELECT e, row_number() OVER (ORDER BY md5('42|' || id), id) AS cell FROM unit
  QUALIFY cell <= (SELECT ceil(count(*) / 64) FROM unit)),
reach AS (
  SELECT u.id, cell, row_number() OVER (
    PARTITION BY u.id ORDER BY list_distance(u.e, p.e), cell) AS near
  FROM unit u, pivots p),
pairs AS (
  SELECT a.id AS src, b.id AS dst,
         round(greatest(1 - list_dot_product(a.e, b.e), 0), 12) AS distance
  FROM reach q JOIN reach o ON q.cell = o.cell AND q.near <= 4 AND o.near = 1 AND q.id <> o.id
  JOIN unit a ON a.id = q.id JOIN unit b ON b.id = o.id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank FROM pairs)
SELECT src, dst, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 5"""


def _trained(gx: int, gy: int, epochs: int, sigma: float = 1.5) -> str:
    """Batch self-organizing map of the embeddings, an epoch per step: ``trained`` (n, e)."""
    wide = max(gx, gy) / 4
    steps = [
        f"""vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
book0 AS (
  SELECT row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS n, e FROM vecs QUALIFY n < {gx * gy})"""
    ]
    for i in range(epochs):
        width = max(sigma, wide * (sigma / wide) ** (i / max(epochs - 1, 1)))
        apart = f"((a.n // {gy} - s.n // {gy}) ** 2 + (a.n % {gy} - s.n % {gy}) ** 2)"
        steps.append(
            f"""hit{i} AS MATERIALIZED (
  SELECT id, n FROM (
    SELECT v.id, b.n, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.e, b.e), b.n) AS rn
    FROM vecs v, book{i} b) WHERE rn = 1),
sums{i} AS MATERIALIZED (
  SELECT h.n, d, sum(v.e[d]) AS total, count(*) AS mass
  FROM hit{i} h JOIN vecs v ON v.id = h.id, range(1, 65) r(d) GROUP BY h.n, d),
book{i + 1} AS MATERIALIZED (
  SELECT n, list(x ORDER BY d) AS e FROM (
    SELECT a.n, s.d, sum(exp(-{apart} / {2 * width * width}) * s.total)
           / sum(exp(-{apart} / {2 * width * width}) * s.mass) AS x
    FROM book{i} a, sums{i} s GROUP BY a.n, s.d) GROUP BY n)"""
        )
    steps.append(f"trained AS (SELECT n // {gy} AS som_x, n % {gy} AS som_y, n, e FROM book{epochs})")
    return ",\n".join(steps)


ORACLE_SQL["som_train"] = f"""
WITH {_trained(6, 5, 5)}
SELECT som_x::INT AS som_x, som_y::INT AS som_y, d::INT - 1 AS pos, round(e[d], 6) AS weight
FROM trained, range(1, 65) r(d)"""
ORACLE_SQL["build_som"] = f"""
WITH {_RECORDS}, {_POINTS}, {_trained(6, 5, 5)},
nearest AS (
  SELECT id, som_x, som_y FROM (
    SELECT v.id, som_x, som_y,
           row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.e, t.e), t.n) AS rn
    FROM vecs v, trained t) WHERE rn = 1),
shown AS (SELECT * FROM records ORDER BY md5('42|' || id), id LIMIT 5000)
SELECT d.id, som_x::INT AS som_x, som_y::INT AS som_y, cluster::INT AS cluster, title, year
FROM shown d JOIN nearest n ON n.id = d.id JOIN points p ON p.id = d.id"""
