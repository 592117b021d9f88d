"""Inputs derived from the test tables, in SQL that Spark and DuckDB both run; {t} is the table."""

DIRTY_ORDERS = """SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN '   ' ELSE o_orderpriority END AS name,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 997 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS amount,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 7 AS INT) END AS score,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS created_at,
  'X' AS constant_col FROM {t}"""
DIRTY_YEARS = DIRTY_ORDERS.replace("'X' AS constant_col", "'X' AS constant_col, CAST(year(o_orderdate) AS INT) AS y")
DIRTY_DUPS = "SELECT o_orderstatus AS status, o_orderpriority AS priority, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS INT) END AS bucket FROM {t}"
DIRTY_CONTACTS = """SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 10 = 0 THEN 'not an email' ELSE concat('user', CAST(c_custkey % 6 AS STRING), '@example.com') END AS contact,
  concat('+1 555 000 ', lpad(CAST(c_custkey % 5 AS STRING), 4, '0')) AS reach,
  CASE WHEN c_custkey % 3 = 0 THEN '4111 1111 1111 1111' ELSE '5500 0000 0000 0004' END AS payment_value,
  concat('192.168.', CAST(c_custkey % 2 AS STRING), '.', CAST(c_custkey % 4 AS STRING)) AS host,
  CASE WHEN c_custkey % 5 < 3 THEN 'ABCDE1234F' ELSE '123412341234' END AS doc,
  concat('0000000', CAST(c_custkey % 8 AS STRING), '-0000-4000-8000-000000000000') AS token,
  c_mktsegment AS segment FROM {t}"""
#: Two states of a table: the second has another type, a column less and one more, nulls, outliers, other contents and repeated rows.
STATE_1 = """SELECT c_custkey AS id, concat('user', CAST(c_custkey % 6 AS STRING), '@example.com') AS contact, c_acctbal AS amount, c_nationkey AS score, c_mktsegment AS segment, 'X' AS flag, c_name AS gone FROM {t}"""
_STATE_2 = """SELECT c_custkey AS id, concat('+1 555 000 ', lpad(CAST(c_custkey % 5 AS STRING), 4, '0')) AS contact,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 16 = 0 THEN CAST(10000000 AS DOUBLE) ELSE c_acctbal END AS amount, CAST(c_nationkey AS DOUBLE) AS score,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS segment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'X' END AS flag, c_mktsegment AS extra FROM {t}"""
STATE_2 = f"{_STATE_2} UNION ALL {_STATE_2} WHERE c_custkey % 10 = 0"
#: Headers that name personal data, over values that fit them fully, by half and not at all.
HEADED = """SELECT CASE WHEN c_custkey % 10 = 0 THEN 'none' ELSE concat('user', CAST(c_custkey % 6 AS STRING), '@example.com') END AS email,
  CASE WHEN c_custkey % 5 < 3 THEN concat('+1 555 000 ', lpad(CAST(c_custkey % 4 AS STRING), 4, '0')) ELSE 'n/a' END AS phone, c_mktsegment AS name, c_mktsegment AS ip_address FROM {t}"""
AS_OF = "1999-06-01 00:00:00"
