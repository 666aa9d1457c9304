"""Sums up a ragged tree of places; comparison of two versions by trees of digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspine.operators import graph
from recordspine.plans.records import rows_of
from recordspine.plans.registry import query
from recordspine.sources import digests
from recordspine.sources.tables import shared_folder

PLACES = "SELECT c_custkey AS place_id, CASE WHEN c_custkey < 4 THEN NULL WHEN c_custkey % 4 = 0 THEN CAST(floor(c_custkey / 2) AS BIGINT) ELSE CAST(c_custkey - c_custkey % 4 AS BIGINT) END AS parent_id FROM customer"


@query(f"""
WITH RECURSIVE p AS ({PLACES}), up AS (SELECT place_id, place_id AS top FROM p UNION ALL SELECT up.place_id, p.parent_id FROM up JOIN p ON p.place_id = up.top WHERE p.parent_id IN (SELECT place_id FROM p)),
o AS (SELECT p.place_id, count(o_orderkey) AS seats, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS verified, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS monitored FROM p LEFT JOIN orders ON o_custkey = p.place_id GROUP BY p.place_id)
SELECT t.top AS place_id, w.seats AS own_seats, CAST(sum(o.seats) AS BIGINT) AS total_seats, w.verified AS own_verified, CAST(sum(o.verified) AS BIGINT) AS total_verified, w.monitored AS own_monitored, CAST(sum(o.monitored) AS BIGINT) AS total_monitored
FROM up t JOIN o ON o.place_id = t.place_id JOIN o w ON w.place_id = t.top GROUP BY ALL
UNION ALL SELECT NULL, count(*), count(*), count(CASE WHEN o_orderstatus = 'F' THEN 1 END), count(CASE WHEN o_orderstatus = 'F' THEN 1 END), count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END), count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) FROM orders WHERE o_custkey NOT IN (SELECT place_id FROM p) HAVING count(*) > 0""")
def atlas_tree(t):
    """The atlas up a tree of places with leaves at all depths: each dimension for the place itself and for all below it."""
    facts = t.orders.withColumn("place_id", F.col("o_custkey"))
    return graph.rollup_tree(rows_of(t, PLACES, "customer"), "place_id", "parent_id", facts, {"seats": F.count(F.lit(1)), "verified": F.count_if(F.col("o_orderstatus") == "F"), "monitored": F.count_if(F.col("o_orderkey") % 3 == 0)})


BEFORE = "SELECT o_orderkey AS record_id, o_custkey AS owner_id, o_orderstatus AS status FROM orders WHERE o_orderkey % 101 <> 7"
AFTER = "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 89 > 0 THEN o_custkey END AS owner_id, CASE WHEN o_orderkey % 97 = 3 THEN 'revised' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 103 <> 5"


@query(f"""
SELECT coalesce(b.record_id, a.record_id) AS record_id, CASE WHEN b.record_id IS NULL THEN 'added' WHEN a.record_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({BEFORE}) b FULL JOIN ({AFTER}) a ON a.record_id = b.record_id
WHERE b.record_id IS NULL OR a.record_id IS NULL OR b.owner_id IS DISTINCT FROM a.owner_id OR b.status IS DISTINCT FROM a.status""")
def version_changes(t):
    """Records that differ between two stored versions."""
    old, new = rows_of(t, BEFORE, "orders"), rows_of(t, AFTER, "orders")
    paths = [shared_folder(t.spark, "version") for _ in range(2)]
    for df, path in zip((old, new), paths):
        digests.store(df, path, ["record_id"])
    return digests.changed_keys(t.spark, *paths, old.schema, ["record_id"])


@query("""
WITH r AS (SELECT substring(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS prefix, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS h FROM orders),
s AS (SELECT prefix, count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substring(h, 46, 15) AS BIGINT)) AS VARCHAR))) AS digest FROM r GROUP BY prefix),
m AS (SELECT left(prefix, 1) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) AS digest FROM s GROUP BY left(prefix, 1))
SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT '', CAST(sum(n) AS BIGINT), sha256(string_agg(prefix || '=' || digest, ',' ORDER BY prefix)) FROM m HAVING count(*) > 0""")
def digest_tree(t):
    """Digests of the orders by ranges of the key's hash, and of ranges of ranges up to the whole table."""
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return digests.tree(t.orders, F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 2), text, 2)
