"""DuckDB SQL for the corpus queries that SQL can express."""
from __future__ import annotations

_USABLE = "list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x::DOUBLE))) = 0"

HARD_NEGATIVES = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_USABLE}),
scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same,
         list_dot_product(a.v, x.v)::BIGINT AS score
  FROM usable a JOIN usable x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""


def _centroids(rounds: int = 10) -> str:
    """Every round as two common table expressions: assignment, then floored means."""
    # the components are integers and sums stay below 2**53, so doubles are exact
    square = "list_dot_product(k.v, k.v) - 2 * list_dot_product(k.v, c.v) + list_dot_product(c.v, c.v)"
    nearest = f"""
SELECT k.vec_id, k.v, arg_min(c.cluster, {{'d': {square}, 'c': c.cluster}}) AS cluster,
       min({square})::BIGINT AS distance
FROM kept k CROSS JOIN c{{n}} c GROUP BY k.vec_id, k.v"""
    parts = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND {_USABLE}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, v
  FROM kept QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8)"""]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.replace('{n}', str(i)).replace('{{', '{').replace('}}', '}')})")
        parts.append(f"""
m{i} AS MATERIALIZED (
  SELECT cluster, list(total ORDER BY place) AS v FROM (
    SELECT cluster, place, floor(sum(x) / count(*)) AS total FROM (
      SELECT cluster, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY cluster, place)
  GROUP BY cluster),
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)""")
    last = nearest.replace("{n}", str(rounds)).replace("{{", "{").replace("}}", "}")
    parts.append(f"final AS MATERIALIZED ({last})")
    return f"""
WITH {','.join(parts)}
SELECT f.vec_id, f.cluster, f.distance, (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(f.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM final f JOIN c{rounds} c ON c.cluster = f.cluster
"""


CENTROIDS = _centroids()

ORACLES: dict[str, str] = {"op12_hard_negatives": HARD_NEGATIVES, "op13_centroids": CENTROIDS}
