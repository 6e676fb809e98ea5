"""Views with personal data, made from the driver's tables by SQL that both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The texts of the two views.
PEOPLE = """
SELECT c_custkey AS id,
  'C' || lpad(CAST(c_custkey AS STRING), 8, '0') AS customer_ref,
  CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE
    CASE c_custkey % 5 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Grace' WHEN 2 THEN 'Alan' WHEN 3 THEN 'Edsger' ELSE 'Barbara' END || ' ' ||
    CASE c_custkey % 7 WHEN 0 THEN 'North' WHEN 1 THEN 'Stone' WHEN 2 THEN 'Field' WHEN 3 THEN 'Brook' WHEN 4 THEN 'Marsh' WHEN 5 THEN 'Wood' ELSE 'Hill' END END AS full_name,
  CASE WHEN c_custkey % 500 = 1 THEN 'repeat@example.test' ELSE 'source' || CAST(c_custkey AS STRING) || '@example.test' END AS email,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE '202-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS phone,
  DATE '1980-01-01' + CAST(c_custkey % 12000 AS INT) AS birth_date,
  lpad(CAST(100 + (c_custkey * 7) % 565 AS STRING), 3, '0') || '-' || CAST(10 + c_custkey % 89 AS STRING) || '-' || CAST(1000 + c_custkey % 8999 AS STRING) AS ssn,
  CASE c_custkey % 4 WHEN 0 THEN '4111-1111-1111-1111' WHEN 1 THEN '5555555555554444' WHEN 2 THEN '378282246310005' ELSE '6011111111111117' END AS card_number,
  CAST(10000 + c_custkey % 89999 AS STRING) AS zip_code,
  '10.' || CAST(c_custkey % 200 AS STRING) || '.' || CAST((c_custkey * 7) % 250 AS STRING) || '.' || CAST(c_custkey % 254 + 1 AS STRING) AS ip_address,
  substr(md5(CAST(c_custkey AS STRING)), 1, 8) || '-' || substr(md5(CAST(c_custkey AS STRING)), 9, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 13, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 17, 4) || '-' || substr(md5(CAST(c_custkey AS STRING)), 21, 12) AS guid,
  CASE c_custkey % 4 WHEN 0 THEN 'Chicago' WHEN 1 THEN 'Austin' WHEN 2 THEN 'Boston' ELSE 'Dallas' END AS city,
  CAST(c_custkey + 1 AS STRING) || ' Oak Avenue' AS street,
  'https://example.test/u/' || CAST(c_custkey AS STRING) AS website,
  CASE WHEN c_custkey % 29 = 0 THEN 'N/A' WHEN c_custkey % 31 = 0 THEN '' ELSE
    CASE c_custkey % 4 WHEN 0 THEN '2001-02-28' WHEN 1 THEN '02/28/2001' WHEN 2 THEN '28-Feb-2001' ELSE 'February 28, 2001' END END AS dob_text,
  CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'inactive' END AS status,
  CAST(1000 + c_custkey % 1000 AS DECIMAL(12,2)) AS credit_limit
FROM customer
"""
ORDERS = """
SELECT CAST((o_orderkey - o_orderkey % 700) / 700 AS BIGINT) + 1 AS tenant_id, o_orderkey % 700 + 1 AS order_id, o_custkey AS customer_id,
  CASE WHEN o_custkey % 500 = 1 THEN 'repeat@example.test' ELSE 'source' || CAST(o_custkey AS STRING) || '@example.test' END AS contact_email,
  CAST(o_orderkey % 5 + 1 AS INT) AS quantity,
  CAST(10 + o_orderkey % 100 AS DECIMAL(10,2)) AS unit_price,
  CAST((o_orderkey % 5 + 1) * (10 + o_orderkey % 100) AS DECIMAL(12,2)) AS total
FROM orders
"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PEOPLE.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def people_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDERS.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
