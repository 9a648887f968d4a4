"""Query op12: centroid clustering of all of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.kdtree_clustering import clustered

ROUNDS = 3


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), rounds=ROUNDS)


def _sql() -> str:
    """Every vector with every centroid, round by round."""
    square = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = f"SELECT v.vec_id, c.cluster, {square} AS distance FROM v, c{{0}} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.cluster) = 1"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INT AS cluster, e FROM v QUALIFY cluster < 16)",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({near.format(r)})",
            # Whole-number floors: % takes the sign of the dividend.
            f"m{r} AS (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM a{r} JOIN v USING (vec_id)) GROUP BY ALL)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS e FROM m{r} GROUP BY cluster) f USING (cluster))",
        ]
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(ROUNDS)})")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


ORACLE = _sql()
