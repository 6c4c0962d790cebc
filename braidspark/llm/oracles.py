"""DuckDB SQL for the queries that SQL can express.

None for the quality classifier and language ID (models), suffix-array dedup (too slow over all windows) and the
token store (a tokenizer): tests/llm holds those against brute force, held-out labels or a round trip.
"""

from __future__ import annotations

from braidspark.llm.mixing import BLOCK_WORDS, BUCKET_DOCS, GOLDEN, LEAST_SLOTS
from braidspark.llm.urlfilter import RULES

_SHINGLES = r"""
{name} AS (
  SELECT DISTINCT {key}, g FROM (
    SELECT {key}, unnest(CASE
      WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {table}))
)"""

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(md5(text), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), c AS (
  SELECT *,
    3 * total - 2 * coalesce(CAST(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_2,
    CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w
  FROM r
), first_open AS (
  SELECT min(k) AS k FROM c WHERE left_2 * w <= 4 * source_size * open_w
), t AS (
  SELECT c.source, c.source_size,
    CASE WHEN c.k < f.k OR f.k IS NULL THEN CAST(2 * c.source_size AS DOUBLE) ELSE CAST(c.w * o.left_2 AS DOUBLE) / (2 * o.open_w) END AS target,
    CASE WHEN c.k < f.k OR f.k IS NULL THEN 2 * c.source_size ELSE (2 * c.w * o.left_2 + 2 * o.open_w) // (4 * o.open_w) END AS goal
  FROM c CROSS JOIN first_open f LEFT JOIN c AS o ON o.k = f.k
), g AS (
  SELECT *, CAST(sum(goal) OVER (ORDER BY source NULLS LAST) AS HUGEINT) AS upto, CAST(sum(goal) OVER () AS HUGEINT) AS goals FROM t
), b AS (
  SELECT *, (upto - goal) * 4294967296 // goals AS low, upto * 4294967296 // goals AS high, CAST(greatest(1, least({BLOCK_WORDS}, goals // {LEAST_SLOTS})) AS BIGINT) AS block FROM g WHERE goals > 0
), points AS (
  SELECT slot, slot % 2147483648 * {GOLDEN} % 4294967296 AS point FROM (SELECT unnest(range(CAST((goals + block - 1) // block AS BIGINT))) AS slot FROM (SELECT DISTINCT goals, block FROM b))
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM points JOIN b ON point >= low AND point < high
), n AS (
  SELECT source, count(*) AS n FROM slots GROUP BY source
), o AS (
  SELECT d.*, t.source_size, t.target, coalesce(b.block, 1) AS block, coalesce(n.n * b.block, 0) AS until,
    coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % ((SELECT count(*) FROM d) // {BUCKET_DOCS} + 1), h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
  greatest(0, least(pos + size, until) - pos) + greatest(0, least(source_size + pos + size, until) - source_size - pos) AS taken,
  CASE WHEN size > 0 THEN slots.slot END AS first_slot
FROM o LEFT JOIN slots ON o.source IS NOT DISTINCT FROM slots.source AND slots.rank = pos // block"""


def _op3() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered))
    # the driver's pages hold no redirects or canonical links, so that every page is its own component; tests/llm has some
    return f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM p"""


OP5 = f"""
WITH RECURSIVE {_SHINGLES.format(name="s", key="doc_id", table="documents")},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE n_both >= 0.8 * (x.n + y.n - n_both) - 1e-9),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, min(root) AS class_id, min(root) = doc_id AS kept FROM r GROUP BY doc_id"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

OP7 = """
WITH c AS (SELECT conv_id, list({r: role, t: text} ORDER BY turn, role, md5(text)) AS l, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, md5(text)) AS rendered FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(0 AS BIGINT) AS segment, CAST(len(l) AS BIGINT) AS n_turns, rendered FROM c a
WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id <> a.conv_id AND b.l[1:len(a.l)] = a.l AND (len(b.l) > len(a.l) OR b.conv_id < a.conv_id))"""

OP10 = f"""
WITH {_SHINGLES.format(name="d", key="doc_id", table="documents")}, {_SHINGLES.format(name="i", key="item_id", table="benchmark")},
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
b AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i ON d.g = i.g GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment FROM b JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9"""

ORACLES: dict[str, str] = {
    "op1_source_mixing": OP1,
    "op3_url_filters": _op3(),
    "op5_minhash_near_dedup": OP5,
    "op6_exact_top_k": OP6,
    "op7_chat_formatting": OP7,
    "op10_benchmark_decontamination": OP10,
}
