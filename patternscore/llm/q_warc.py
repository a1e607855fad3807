"""op6: all pages to WARC archives and back."""

from .common import new_path
from .warc import page_records, read_archives, write_archives


def op6_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(read_archives(spark, path))


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL = {
    "op6_warc": """
WITH b AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM b)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
}
