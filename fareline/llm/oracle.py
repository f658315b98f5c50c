"""DuckDB counterparts of the queries whose whole result SQL can express."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
BLANK = r"'[^\x20\x09-\x0D]+'"


def words_of(table: str, key: str, pattern: str) -> str:
    lowered = LOWER.format("coalesce(text, '')")
    return f"SELECT {key}, regexp_extract_all({lowered}, {pattern}) AS w FROM {table}"


DECONTAMINATE = f"""WITH d AS ({words_of("documents", "doc_id", ALNUM)}),
i AS ({words_of("benchmark", "CAST(item_id AS VARCHAR) AS item", ALNUM)}),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes
        WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, p.n AS n, item FROM places p JOIN item_windows USING (words, n)),
found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
    array_to_string(list_sort(list(DISTINCT item)), ',') AS items
  FROM hits GROUP BY doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS place FROM hits),
islands AS (
  SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island
  FROM covered),
runs AS (SELECT doc_id, island, count(*) AS size FROM islands GROUP BY ALL),
sums AS (SELECT doc_id, sum(size) AS n_hit, max(size) AS longest FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

SUFFIX_DEDUP = """WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n
  FROM documents),
windows AS (
  SELECT doc_id, s, md5(substring(h, CAST(2 * s + 1 AS BIGINT), 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(n - 99)) AS s FROM b WHERE n >= 100)),
repeats AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
steps AS (
  SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS apart FROM repeats),
numbered AS (
  SELECT doc_id, s, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY s) AS run
  FROM steps),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS e FROM numbered GROUP BY ALL),
ends AS (
  SELECT doc_id, a, e FROM runs
  UNION ALL SELECT doc_id, n, n FROM b),
kept AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 0) AS x, a AS y
  FROM ends),
texts AS (
  SELECT doc_id, sum(y - x) AS size,
    string_agg(substring(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x)
      AS h
  FROM kept JOIN b USING (doc_id) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n - size AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(texts.h)) AS kept_sha256
FROM b JOIN texts USING (doc_id) LEFT JOIN counts USING (doc_id)"""

JACCARD_JOIN = f"""WITH RECURSIVE d AS ({words_of("documents", "doc_id", BLANK)}),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reached AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles,
  min(other) AS component_id
FROM d JOIN reached USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id"""
