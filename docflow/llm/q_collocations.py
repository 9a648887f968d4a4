"""Query op11: phrase collocations of all of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docflow.llm.collocations import collocations


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.size, k.a, k.ws, k.k, h.f AS l, t.f AS r, (2000000::HUGEINT * k.a // (h.f::HUGEINT + t.f))::BIGINT AS score
      FROM k JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f t ON t.lang = k.lang AND t.phrase = array_to_string(k.ws[k.k + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
free AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = s.lang AND c.size > s.size AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * c.a >= 80 * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM free JOIN n USING (lang) QUALIFY rank <= 2000
"""
