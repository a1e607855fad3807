"""op2 and op10: repeated passages of all documents, by words and by bytes."""

from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup, "op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (
  SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
),
twice AS (SELECT win FROM spots GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM spots SEMI JOIN twice USING (win)),
gone_lists AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone_lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
