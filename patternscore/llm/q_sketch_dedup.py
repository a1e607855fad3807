"""op11: components of similar documents, by SetSketch registers."""

from .sketch_dedup import similar_sets


def op11_setsketch(spark, sf_dir):
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_setsketch": op11_setsketch}
ORACLE_SQL = {
    "op11_setsketch": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS g FROM w),
n AS (SELECT r, doc_id, len(g) AS n FROM s), e AS (SELECT r, unnest(g) AS h FROM s),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM e a JOIN e b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
undirected AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, u.b FROM reach JOIN undirected u ON reach.b = u.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN n ON n.r = b GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least ON a = r
"""
}
