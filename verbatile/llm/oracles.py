"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffled
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM s
), l AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY 3 * source_size / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM w
), t AS (
  SELECT source, source_size,
         least(cap::DOUBLE, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight) AS target
  FROM l
), o AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), i AS (
  SELECT doc_id, source, size, pass, (pass * source_size + before + size)::DOUBLE / target AS finish
  FROM o, (SELECT unnest([0, 1, 2])::BIGINT AS pass) WHERE size > 0
), q AS (
  SELECT doc_id, sum(greatest(least((SELECT sum(size) FROM d)::BIGINT - ended, size), 0))::BIGINT AS taken
  FROM (
    SELECT doc_id, size,
           coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ended
    FROM i
  )
  GROUP BY doc_id
)
SELECT o.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken,
       CASE WHEN target > 0 THEN (before + size)::DOUBLE / target END AS finish
FROM o LEFT JOIN q ON o.doc_id = q.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op6_weighted_fair_mix": OP6}
