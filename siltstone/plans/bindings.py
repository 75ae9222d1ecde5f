"""How driver tables stand in for the library's inputs: SQL that Spark and DuckDB both run.

Table names are placeholders: Spark gets DataFrames for them, DuckDB its views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import parts_for, read_table

OFFERS = """
SELECT l_orderkey * 10 + l_linenumber AS offer_id, p_partkey AS product, s_name AS store, p_name AS name,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE p_brand END AS brand,
  CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS package_size,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(p_retailprice * (1 - l_discount) * 4) AS DOUBLE) / 4 END AS price,
  CASE WHEN l_orderkey % 3 = 0 THEN 'USD' WHEN l_orderkey % 3 = 1 THEN 'EUR' ELSE 'UZS' END AS currency,
  l_linestatus = 'O' AS in_stock
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

FLIGHTS = """
SELECT concat('SX', CAST(o_orderkey AS STRING)) AS flight_number, c_mktsegment AS airline, concat('C', CAST(c_nationkey AS STRING)) AS airline_code,
  o_custkey % 50 AS route, 'TAS' AS origin, 'IST' AS destination,
  CAST(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' ', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':15:00') AS TIMESTAMP) AS departure_time,
  CAST(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 23:45:00') AS TIMESTAMP) AS arrival_time,
  CAST(45 + (o_orderkey * 37) % 600 AS INT) AS duration_minutes, CAST(o_orderkey % 3 AS INT) AS stops,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ECONOMY' ELSE '' END AS cabin_class,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 100) AS DOUBLE) / 4 END AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN 'USD' WHEN o_orderkey % 3 = 1 THEN 'EUR' ELSE 'TRY' END AS currency,
  o_orderstatus AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

SEARCHES = """
SELECT event_id AS id, concat(event_type, '-', CAST(user_id % 20 AS STRING)) AS query, CAST(ts AS TIMESTAMP) AS searched_at,
  CAST(floor(value) AS BIGINT) % 5 AS result_count
FROM {events}
"""

FILES = """
SELECT concat('txt/', source, '/', CAST(doc_id % 7 AS STRING), '/', lpad(CAST(doc_id AS STRING), 9, '0'), '.txt') AS path,
  sha256(text) AS file_hash, doc_id, length(text) AS n_bytes
FROM {documents}
"""

#: Documents as they were before: one in five missing, one in seven with other content.
KNOWN = """
SELECT concat('d', CAST(doc_id AS STRING)) AS id, concat('txt/', source, '/', CAST(doc_id % 7 AS STRING), '/', lpad(CAST(doc_id AS STRING), 9, '0'), '.txt') AS file_path,
  CASE WHEN doc_id % 7 = 0 THEN sha256(concat(text, '!')) ELSE sha256(text) END AS file_hash
FROM {documents} WHERE doc_id % 5 <> 0
"""

TRANSACTIONS = """
SELECT o_orderkey AS id, CAST(floor(o_totalprice / 25) AS DOUBLE) / 4 AS amount,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE c_acctbal END AS avg_amount_user,
  CAST(o_orderkey % 40 AS INT) AS total_transactions_user, CAST((o_orderkey * 7) % 900 AS INT) AS account_age_days,
  c_mktsegment AS merchant_category, CASE WHEN o_orderkey % 12 = 5 THEN NULL ELSE o_orderpriority END AS channel, o_orderstatus AS country,
  concat('n', CAST(c_nationkey AS STRING)) AS bin_country, o_totalprice / 1000 AS shipping_distance_km,
  CASE WHEN (o_orderkey * 31) % 100 < CASE WHEN o_totalprice > 300000 THEN 60 ELSE 5 END THEN 1 ELSE 0 END AS is_fraud
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def bound(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None, rows_each: int = 500_000) -> DataFrame:
    """The binding over the tables in `sf_dir`.

    Those in `dealt` are dealt by the column given there, all in as many parts as keep a part of the largest at
    some `rows_each` rows; what joins and groups by these columns then stays in its part.
    """
    text = sql.replace("sha256(text)", "sha2(text, 256)").replace("sha256(concat(text, '!'))", "sha2(concat(text, '!'), 256)")
    tables = {t: read_table(spark, sf_dir, t) for t in tables_of(sql)}
    if dealt:
        parts = parts_for(spark, max(tables[t].count() for t in dealt), rows_each)
        tables |= {t: tables[t].repartition(parts, by) for t, by in dealt.items()}
    return spark.sql(text, **tables)


def duck(sql: str) -> str:
    """The binding for DuckDB."""
    return sql.format(**{t: t for t in tables_of(sql)})
