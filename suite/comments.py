"""A table of free-text comments derived from orders: the fixture of the queries.

Raw tables hold few UK-shaped values; this relation gives every detector hits.
The same statement runs on Spark SQL and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

COMMENTS_SQL = """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 12
    WHEN 0 THEN 'Miss Harlow sent the form back, REP-2023-' || lpad(cast(o_orderkey % 100000 AS string), 5, '0') || ', call 07' || lpad(cast(o_orderkey * 7919 % 1000000000 AS string), 9, '0')
    WHEN 1 THEN 'Tenant rang, key safe: ' || cast(1000 + o_orderkey % 9000 AS string) || ' flat at SW1A ' || cast(o_orderkey % 10 AS string) || 'AA'
    WHEN 2 THEN 'Name: Mr T B Quill' || chr(10) || 'NI no AB' || lpad(cast(o_orderkey % 1000000 AS string), 6, '0') || 'C'
    WHEN 3 THEN 'REF ' || cast(10000 + o_orderkey % 89999 AS string) || ' for mr & mrs tanner, 0191 ' || cast(100 + o_orderkey % 900 AS string) || ' ' || cast(1000 + o_orderkey % 9000 AS string)
    WHEN 4 THEN 'Email user' || cast(o_orderkey AS string) || '@example.com, customer-' || cast(1000 + o_orderkey % 9000 AS string)
    WHEN 5 THEN 'GB123456A is not valid, AB 12 34 56 D is, ask +44 7700 ' || lpad(cast(o_orderkey % 1000000 AS string), 6, '0')
    WHEN 6 THEN NULL
    WHEN 7 THEN 'Tenancy ' || cast(100000 + o_orderkey AS string) || ' in BH-' || cast(100 + o_orderkey % 900 AS string) || ' and BH 123 456 seen'
    WHEN 8 THEN 'Café visit on 12/03/2024, code ' || cast(1000 + o_orderkey % 9000 AS string) || ' left by Sarah Jones'
    WHEN 9 THEN 'ab123456c <PERSON> Name: <PERSON>'
    WHEN 10 THEN 'Good morning, account ' || cast(10000000 + o_orderkey AS string) || ' ref ' || cast(1000 + o_orderkey % 9000 AS string)
    ELSE 'no personal data here ' || cast(o_orderkey % 1000 AS string)
  END AS notes,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Spoke to Mr Brown about postcode TS' || cast(1 + o_orderkey % 9 AS string) || ' ' || cast(o_orderkey % 10 AS string) || 'AB'
    WHEN o_orderkey % 5 = 1 THEN 'Seen on March ' || cast(1 + o_orderkey % 28 AS string) || ', 2024 and 2024-03-12T10:30:00Z; date due 2024-05-0' || cast(1 + o_orderkey % 9 AS string) || ', then June 2025 or 4 Aug 2023'
    WHEN o_orderkey % 5 = 2 THEN 'Wrote to "josé.' || cast(o_orderkey AS string) || '@exámple.es" and o''brien+' || repeat('x', 70) || '@mail.example.ie, pin 0191 101 1001'
    END AS description,
  o_orderpriority AS category
FROM {orders}
"""


def comments(orders: DataFrame) -> DataFrame:
    """The comments relation over an orders DataFrame; columns prune to the scan."""
    return orders.sparkSession.sql(COMMENTS_SQL, orders=orders)
