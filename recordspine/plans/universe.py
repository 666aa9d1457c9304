"""Finite universes, money, commitments, submissions and planning catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordspine.functions import ladders
from recordspine.operators import quality, relational
from recordspine.plans.registry import query

DEC = "decimal(18,2)"


def units(t):
    """Orders as a universe of units by customer: expected, accounted, excluded."""
    o = t.orders
    return o.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("accounted"), F.count_if(F.col("o_orderstatus") == "P").alias("excluded"), F.count_distinct("o_orderpriority").alias("families"), F.max(F.to_date("o_orderdate")).alias("cutoff"))


UNITS = "SELECT o_custkey AS subject_id, count(*) AS expected, count(*) FILTER (WHERE o_orderstatus = 'F') AS accounted, count(*) FILTER (WHERE o_orderstatus = 'P') AS excluded, count(DISTINCT o_orderpriority) AS families, max(CAST(o_orderdate AS DATE)) AS cutoff FROM orders GROUP BY o_custkey"


LEADS = "SELECT o_custkey AS subject_id, count(DISTINCT year(o_orderdate)) AS passes, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS leads FROM orders GROUP BY o_custkey"


@query(f"""
WITH r AS (SELECT u.subject_id, finite, CASE WHEN u.subject_id % 17 = 0 THEN 'REOPENED:MATERIAL_MISS_REOPENED_SCOPE' WHEN u.subject_id % 13 = 0 THEN 'CAPABILITY_BLOCKED:REQUIRED_CAPABILITY_BLOCKED' WHEN u.subject_id % 11 = 0 THEN 'SOURCE_BLOCKED:REQUIRED_SOURCE_FAMILY_BLOCKED'
  WHEN finite AND wanted IS NULL THEN 'IN_PROGRESS:FINITE_SCOPE_REQUIRES_EXPECTED_UNITS' WHEN finite AND accounted + missing > wanted THEN 'REOPENED:ACCOUNTED_PLUS_MISSING_EXCEEDS_EXPECTED_UNITS' WHEN finite AND NOT audited THEN 'IN_PROGRESS:FINITE_SCOPE_REQUIRES_CUTOFF_AND_INDEPENDENT_AUDIT'
  WHEN finite AND (accounted <> wanted OR missing <> 0) THEN 'IN_PROGRESS:FINITE_SCOPE_HAS_UNACCOUNTED_UNITS' WHEN finite THEN 'RECONCILED_THROUGH:FINITE_SCOPE_RECONCILED_TO_EXPLICIT_CUTOFF'
  WHEN families < 2 OR passes < 2 THEN 'IN_PROGRESS:OPEN_SCOPE_REQUIRES_MULTIPLE_SOURCE_FAMILIES_AND_PASSES' WHEN leads > 0 THEN 'IN_PROGRESS:OPEN_SCOPE_HAS_UNRESOLVED_LEADS' WHEN NOT audited THEN 'IN_PROGRESS:OPEN_SCOPE_REQUIRES_AUDIT_AND_AS_OF_BOUNDARY'
  ELSE 'SEARCH_SATURATED_AS_OF:OPEN_SCOPE_SATURATED_ONLY_FOR_DECLARED_AS_OF_BOUNDARY' END AS said
FROM (SELECT *, subject_id % 2 = 0 AS finite, CASE WHEN subject_id % 10 > 0 THEN accounted + excluded END AS wanted, CASE WHEN subject_id % 6 = 4 THEN 0 WHEN subject_id % 8 = 2 THEN expected ELSE excluded END AS missing, subject_id % 3 <> 0 AS audited FROM ({UNITS})) u JOIN ({LEADS}) l ON l.subject_id = u.subject_id)
SELECT subject_id, finite, split_part(said, ':', 1) AS state, split_part(said, ':', 2) AS reason FROM r""")
def coverage_state(t):
    """State and reason of each scope's coverage; passes are the years in which it was looked at, leads its urgent open orders."""
    i = F.col("subject_id")
    wanted = F.when(i % 10 > 0, F.col("accounted") + F.col("excluded"))
    missing = F.when(i % 6 == 4, 0).when(i % 8 == 2, F.col("expected")).otherwise(F.col("excluded"))
    leads = t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count_distinct(F.year("o_orderdate")).alias("passes"), F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).alias("leads"))
    u = units(t).join(leads, "subject_id").withColumns({"finite": i % 2 == 0, "wanted": wanted, "missing": missing, "audited": i % 3 != 0})
    c = F.col
    inputs = [c("finite"), c("wanted"), c("accounted"), c("missing"), c("cutoff"), c("audited"), c("families"), c("passes"), c("leads"), i % 17 == 0, i % 13 == 0, i % 11 == 0]
    return u.select("subject_id", "finite", ladders.coverage_state(*inputs).alias("state"), ladders.coverage_reason(*inputs).alias("reason"))


@query(f"""SELECT subject_id, expected, accounted, CASE WHEN subject_id % 5 = 0 THEN 'checked_no_authoritative_result' WHEN accounted = 0 THEN 'not_collected' WHEN expected > 0 AND accounted >= expected - excluded AND accounted >= expected THEN 'coverage_complete_for_defined_scope' ELSE 'incomplete' END AS state FROM ({UNITS})""")
def dataset_reconciliation(t):
    u = units(t)
    state = ladders.dataset_state(F.col("subject_id") % 5 != 0, F.col("expected"), F.col("accounted"), F.greatest(F.lit(0), F.col("expected") - F.col("excluded") - F.col("accounted")))
    return u.select("subject_id", "expected", "accounted", state.alias("state"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT o_custkey AS subject_id, count(*) AS filings, count(*) FILTER (WHERE r = 1) AS units, count(*) FILTER (WHERE r > 1) AS amended, count(*) FILTER (WHERE r = 1 AND o_orderstatus = 'P') AS excluded,
  CAST(sum(CASE WHEN r = 1 AND o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS total FROM a GROUP BY o_custkey""")
def finite_reconciliation(t):
    w = Window.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy(F.desc("o_orderkey"))
    a = t.orders.withColumn("r", F.row_number().over(w))
    last = F.col("r") == 1
    kept = F.when(last & (F.col("o_orderstatus") != "P"), F.col("o_totalprice").cast(DEC)).otherwise(F.lit(0).cast(DEC))
    return a.groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count(F.lit(1)).alias("filings"), F.count_if(last).alias("units"), F.count_if(~last).alias("amended"), F.count_if(last & (F.col("o_orderstatus") == "P")).alias("excluded"), F.sum(kept).cast("decimal(38,2)").alias("total"))


@query("SELECT o_custkey AS subject_id, string_agg(DISTINCT trim(o_orderpriority), ',' ORDER BY trim(o_orderpriority)) AS families, count(DISTINCT trim(o_orderpriority)) AS n FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY o_custkey")
def family_sets(t):
    g = t.orders.where(F.trim("o_orderpriority") != "").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.collect_set(F.trim("o_orderpriority")).alias("s"))
    return g.select("subject_id", F.array_join(F.sort_array("s"), ",").alias("families"), F.size("s").cast("long").alias("n"))


@query("SELECT o_orderpriority AS kind, o_orderstatus AS state, count(*) AS n, count(DISTINCT o_custkey) AS subjects FROM orders GROUP BY ALL")
def coverage_by_kind(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("subjects"))


@query("""
SELECT cohort, array_to_string(list_filter([CASE WHEN failures / n > 0.32 THEN 'high_parser_failure' END, CASE WHEN dead >= 3 THEN 'dead_letter_threshold' END, CASE WHEN n = 0 THEN 'unexpected_zero_record_parse' END], lambda x: x IS NOT NULL), ',') AS blockers, failures / n <= 0.32 AND dead < 3 AS allowed
FROM (SELECT c_mktsegment AS cohort, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS failures, count(*) FILTER (WHERE o_totalprice < 1500) AS dead FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment)""")
def cohort_gate(t):
    g = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cohort")), "o_custkey").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("failures"), F.count_if(F.col("o_totalprice") < 1500).alias("dead"))
    b = ladders.blockers(high_parser_failure=F.col("failures") / F.col("n") > 0.32, dead_letter_threshold=F.col("dead") >= 3, unexpected_zero_record_parse=F.col("n") == 0)
    return g.select("cohort", F.array_join(b, ",").alias("blockers"), (F.size(b) == 0).alias("allowed"))


@query("""
WITH expected AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), found AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 5 <> 0)
SELECT coalesce(e.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'covered' END AS status FROM expected e FULL JOIN found f ON f.id = e.id""")
def coverage_gap_sets(t):
    expected = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("e"))
    found = t.orders.where("o_orderstatus = 'F' AND o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id"), F.lit(True).alias("f")).distinct()
    return expected.join(found, "id", "full_outer").select("id", F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("covered").alias("status"))


CLASSES = ["IMMUTABLE", "LOW", "MEDIUM", "HIGH", "ELECTION_REALTIME"]
CLASS_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
SECONDS_SQL = "CASE k " + " ".join(f"WHEN '{c}' THEN CASE WHEN near THEN {e} ELSE {n} END" for c, (n, e) in ladders.REFRESH_SECONDS.items()) + " END"


@query(f"SELECT order_id, k AS refresh_class, seen + INTERVAL 1 SECOND * ({SECONDS_SQL}) AS next_check_at FROM (SELECT o_orderkey AS order_id, {CLASS_SQL} AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS seen, o_orderkey % 90 <= 45 AS near FROM orders)")
def next_check_at(t):
    return checks(t).select("order_id", "refresh_class", "next_check_at")


def checks(t):
    o = t.orders.select(F.col("o_orderkey").alias("order_id"), F.expr(CLASS_SQL).alias("refresh_class"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("at"), (F.col("o_orderkey") % 90).cast("int").alias("days"))
    return o.withColumn("next_check_at", F.col("at") + F.make_dt_interval(secs=ladders.refresh_seconds(F.col("refresh_class"), F.col("days")).cast("decimal(18,6)")))


@query(f"SELECT order_id, k AS refresh_class FROM (SELECT o_orderkey AS order_id, {CLASS_SQL} AS k, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS seen, o_orderkey % 90 <= 45 AS near FROM orders) WHERE seen + INTERVAL 1 SECOND * ({SECONDS_SQL}) <= TIMESTAMP '1996-01-01 00:00:00'")
def monitoring_due(t):
    return checks(t).where(F.col("next_check_at") <= F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")).select("order_id", "refresh_class")


@query("""
WITH g AS (SELECT l_suppkey AS subject_id, l_partkey AS object_id, year(l_shipdate) AS cycle, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY ALL)
SELECT subject_id, cycle, object_id, n, CAST(amount AS DECIMAL(28,2)) AS amount, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, cycle ORDER BY amount DESC, object_id) AS r FROM g) WHERE r <= 5""")
def relationship_rollup(t):
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id"), F.year("l_shipdate").cast("long").alias("cycle")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(DEC)).cast("decimal(28,2)").alias("amount"))
    return relational.top_k(g, ["subject_id", "cycle"], [F.col("amount").desc(), F.col("object_id")], 5).select("subject_id", "cycle", "object_id", "n", "amount", "rank")


@query("""
WITH u AS (SELECT l_orderkey AS scope_id, count(*) AS accounted, count(*) FILTER (WHERE l_returnflag = 'R') AS missing, max(l_linenumber) AS expected FROM lineitem GROUP BY l_orderkey)
SELECT scope_id, 'accounted_plus_missing_exceeds_expected' AS rule FROM u WHERE accounted + missing > expected UNION ALL SELECT scope_id, 'negative_units' FROM u WHERE expected < 0 UNION ALL SELECT scope_id, 'nothing_expected' FROM u WHERE expected < 2""")
def constraint_violations(t):
    u = t.lineitem.groupBy(F.col("l_orderkey").alias("scope_id")).agg(F.count(F.lit(1)).alias("accounted"), F.count_if(F.col("l_returnflag") == "R").alias("missing"), F.max("l_linenumber").alias("expected"))
    return quality.violations(u, ["scope_id"], {"accounted_plus_missing_exceeds_expected": F.col("accounted") + F.col("missing") > F.col("expected"), "negative_units": F.col("expected") < 0, "nothing_expected": F.col("expected") < 2})


@query("SELECT o_orderkey AS order_id, count(*) AS late_rows, min(CAST(l_shipdate AS DATE)) AS first_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) GROUP BY o_orderkey")
def temporal_coherence(t):
    j = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("ship")).join(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("od")), "o_orderkey").where("ship < od")
    return j.groupBy(F.col("o_orderkey").alias("order_id")).agg(F.count(F.lit(1)).alias("late_rows"), F.min("ship").alias("first_ship"))


# What a commitment's status counts; the others stay out of the denominator.
STATUSES = ["kept", "partially_kept", "in_progress", "compromised", "blocked", "broken", "reversed", "unclear", "not_applicable"]
STATUS_VALUE = {"kept": 1.0, "partially_kept": 0.6, "compromised": 0.5, "broken": 0.0, "reversed": 0.0}
STATUS_SQL = "CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"
VALUE_SQL = "CASE status " + " ".join(f"WHEN '{s}' THEN {v:.1f}" for s, v in STATUS_VALUE.items()) + " END"


def status_value():
    out = F.lit(None).cast("double")
    for s, v in STATUS_VALUE.items():
        out = F.when(F.col("status") == s, v).otherwise(out)
    return out


@query(f"SELECT brand, count(*) AS commitments, count({VALUE_SQL}) AS scored, round(avg(CAST({VALUE_SQL} AS DOUBLE)), 4) AS score, round(count({VALUE_SQL}) / count(*), 4) AS completeness FROM (SELECT p_brand AS brand, {STATUS_SQL} AS status FROM part) GROUP BY brand")
def promise_score(t):
    p = t.part.select(F.col("p_brand").alias("brand"), F.expr(STATUS_SQL).alias("status"))
    v = status_value()
    return p.groupBy("brand").agg(F.count(F.lit(1)).alias("commitments"), F.count(v).alias("scored"), F.round(F.avg(v), 4).alias("score"), F.round(F.count(v) / F.count(F.lit(1)), 4).alias("completeness"))


@query(f"""
WITH c AS (SELECT p_brand AS brand, avg(CASE WHEN p_size % 9 IN (0,1) THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN p_size % 3 = 0 THEN p_retailprice / 2000 END) AS b, avg(CASE WHEN p_size > 50 THEN 1.0 END) AS d FROM part GROUP BY p_brand)
SELECT brand, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2 THEN round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(d * 0.2, 0)) / ((a IS NOT NULL)::INT * 0.5 + (b IS NOT NULL)::INT * 0.3 + (d IS NOT NULL)::INT * 0.2), 4) END AS composite FROM c""")
def composite_score(t):
    parts = {"a": (F.avg(F.when(F.col("p_size") % 9 < 2, 1.0).otherwise(0.0)), 0.5), "b": (F.avg(F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") / 2000)), 0.3), "d": (F.avg(F.when(F.col("p_size") > 50, 1.0)), 0.2)}
    g = t.part.groupBy(F.col("p_brand").alias("brand")).agg(*(x.alias(k) for k, (x, _) in parts.items()))
    known = sum((F.col(k).isNotNull().cast("int") for k in parts), F.lit(0))
    weight = sum((F.col(k).isNotNull().cast("int") * w for k, (_, w) in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, (_, w) in parts.items()), F.lit(0.0))
    return g.select("brand", F.when(known >= 2, F.round(total / weight, 4)).alias("composite"))


@query("""
WITH w AS (SELECT s_suppkey AS id, s_nationkey AS region, s_suppkey % 5 AS family, s_suppkey % 3 AS phase FROM supplier), g AS (SELECT region, family, phase, min(id) AS first_id, count(*) AS members FROM w GROUP BY ALL HAVING count(*) > 1)
SELECT w.id, g.first_id, g.members FROM w JOIN g ON g.region = w.region AND g.family = w.family AND g.phase = w.phase""")
def scope_overlaps(t):
    """Workstreams of one scope overlap: each with the scope's first and the number of them, not every pair."""
    w = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("region"), (F.col("s_suppkey") % 5).alias("family"), (F.col("s_suppkey") % 3).alias("phase"))
    g = w.groupBy("region", "family", "phase").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return w.join(g, ["region", "family", "phase"]).select("id", "first_id", "members")


STREAM_PATH = "concat_ws('/', 'data', CAST(s_nationkey AS STRING), CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 5 AS STRING) END, CASE WHEN s_suppkey % 3 > 1 THEN CAST(s_suppkey % 7 AS STRING) END)"


@query(f"""
WITH w AS (SELECT s_suppkey AS id, {STREAM_PATH} AS path FROM supplier), p AS (SELECT path, count(*) AS owners FROM w GROUP BY path)
SELECT p.path, p.owners, count(w.id) AS inside FROM p JOIN w ON w.path = p.path OR starts_with(w.path, p.path || '/') GROUP BY p.path, p.owners HAVING count(w.id) > 1""")
def path_overlaps(t):
    """Paths with all workstreams at or below them: each path meets its own beginnings by equality."""
    w = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr(STREAM_PATH).alias("own"))
    parts = F.split("own", "/")
    above = w.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
    inside = above.groupBy("path").agg(F.count(F.lit(1)).alias("inside")).where("inside > 1")
    return w.groupBy(F.col("own").alias("path")).agg(F.count(F.lit(1)).alias("owners")).join(inside, "path").select("path", "owners", "inside")


# Units of capability families and the source families of a pass plan.
FAMILIES = {"finance": ["receipts", "spending", "loans"], "elections": ["results", "filings"], "legislative": ["bills", "votes", "committees"], "disclosures": ["assets", "gifts"]}
FAMILY_ROWS = [(f, i, u) for f, us in FAMILIES.items() for i, u in enumerate(us)]
FAMILY_SQL = ", ".join(f"('{f}', {i}, '{u}')" for f, i, u in FAMILY_ROWS)


@query(f"SELECT s.seat_id, f.family, f.unit, 'family:' || f.family || ':' || f.unit || ':' || CAST(s.seat_id AS STRING) AS identity FROM fx_seats s CROSS JOIN (VALUES {FAMILY_SQL}) AS f(family, i, unit)")
def family_fanout(t):
    units_ = F.explode(F.create_map(*(x for f, us in FAMILIES.items() for x in (F.lit(f), F.array(*map(F.lit, us))))))
    s = t.seats.select("seat_id", units_.alias("family", "us")).select("seat_id", "family", F.explode("us").alias("unit"))
    return s.withColumn("identity", F.concat_ws(":", F.lit("family"), "family", "unit", F.col("seat_id").cast("string")))


@query(f"""
SELECT s.seat_id, f.family, f.unit AS source_family, p.p AS pass FROM fx_seats s CROSS JOIN (VALUES {FAMILY_SQL}) AS f(family, i, unit) CROSS JOIN (VALUES (1), (2)) AS p(p)
WHERE p.p = 1 OR f.family IN ('legislative', 'disclosures')""")
def source_pass_plan(t):
    rows = F.broadcast(t.spark.createDataFrame([(f, u, f in ("legislative", "disclosures")) for f, _, u in FAMILY_ROWS], "family string, source_family string, open_ended boolean"))
    plan = t.seats.select("seat_id").crossJoin(rows)
    return plan.select("seat_id", "family", "source_family", F.explode(F.sequence(F.lit(1), F.when(F.col("open_ended"), 2).otherwise(1))).alias("pass"))


@query(f"""
WITH u AS (SELECT s.seat_id, s.office_type, f.family, f.unit, f.i FROM fx_seats s CROSS JOIN (VALUES {FAMILY_SQL}) AS f(family, i, unit) WHERE s.monitoring_active),
src AS (SELECT source_key, CAST(row_number() OVER (ORDER BY source_key) AS INT) AS pos FROM (SELECT DISTINCT source AS source_key FROM documents)),
pref AS (SELECT u.seat_id, u.family, u.unit, string_agg(src.source_key, ',' ORDER BY src.pos) AS sources FROM u JOIN src ON src.pos % 5 = u.i AND src.pos <= 15 GROUP BY ALL)
SELECT u.seat_id, u.family, u.unit, coalesce(pref.sources, '') AS sources, CASE WHEN pref.sources IS NULL THEN 'blocked' ELSE 'planned' END AS status FROM u LEFT JOIN pref ON pref.seat_id = u.seat_id AND pref.family = u.family AND pref.unit = u.unit""")
def dossier_graph(t):
    rows = F.broadcast(t.spark.createDataFrame(FAMILY_ROWS, "family string, i int, unit string"))
    src = t.documents.select(F.col("source").alias("source_key")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("source_key"))).where("pos <= 15")  # a short registry
    pref = src.groupBy((F.col("pos") % 5).cast("int").alias("i")).agg(F.array_sort(F.collect_list(F.struct("pos", "source_key"))).alias("s")).select("i", F.array_join(F.slice("s.source_key", 1, 3), ",").alias("sources"))
    u = t.seats.where("monitoring_active").select("seat_id").crossJoin(rows).join(F.broadcast(pref), "i", "left")
    return u.select("seat_id", "family", "unit", F.coalesce("sources", F.lit("")).alias("sources"), F.when(F.col("sources").isNull(), "blocked").otherwise("planned").alias("status"))


CATALOG = [(0, "finance", "*", "generic"), (1, "*", "governor", "executive"), (2, "finance", "mayor", "local"), (3, "*", "*", "fallback")]
CATALOG_SQL = ", ".join(f"({p}, '{s}', '{u}', '{k}')" for p, s, u, k in CATALOG)


@query(f"""
SELECT seat_id, scope, key FROM (SELECT s.seat_id, x.scope, c.key, row_number() OVER (PARTITION BY s.seat_id, x.scope ORDER BY c.pos) AS r FROM fx_seats s CROSS JOIN (VALUES ('finance'), ('media')) AS x(scope)
JOIN (VALUES {CATALOG_SQL}) AS c(pos, scope, unit, key) ON (c.scope = '*' OR c.scope = x.scope) AND (c.unit = '*' OR c.unit = s.office_type)) WHERE r = 1""")
def capability_match(t):
    catalog = F.broadcast(t.spark.createDataFrame(CATALOG, "pos int, c_scope string, c_unit string, key string"))
    s = t.seats.select("seat_id", "office_type", F.explode(F.array(F.lit("finance"), F.lit("media"))).alias("scope"))
    hit = s.join(catalog, F.col("c_scope").isin("*") | (F.col("c_scope") == F.col("scope"))).where((F.col("c_unit") == "*") | (F.col("c_unit") == F.col("office_type")))
    return hit.groupBy("seat_id", "scope").agg(F.min_by("key", "pos").alias("key"))


@query("""
SELECT c_custkey AS record_id, r AS rule FROM (
  SELECT c_custkey, unnest(list_filter([CASE WHEN c_name IS NULL OR c_name = '' THEN 'name_missing' END, CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN NOT regexp_matches(c_mktsegment, '^[A-Z]+$') THEN 'segment_shape' END, CASE WHEN c_custkey % 97 = 0 THEN 'status_literal' END], lambda x: x IS NOT NULL)) AS r FROM customer)""")
def dq_violations(t):
    return quality.violations(t.customer.withColumnRenamed("c_custkey", "record_id"), ["record_id"], {"name_missing": F.coalesce("c_name", F.lit("")) == "", "negative_balance": F.col("c_acctbal") < 0, "segment_shape": ~F.col("c_mktsegment").rlike("^[A-Z]+$"), "status_literal": F.col("record_id") % 97 == 0})


def submissions(t):
    return t.conversations.select(F.col("role").alias("producer"), F.col("conv_id").alias("job_id"), "turn", F.md5(F.col("text").cast("binary")).alias("hash"))


SUBMISSIONS = "SELECT role AS producer, conv_id AS job_id, turn, md5(text) AS hash FROM conversations"


@query(f"""
WITH s AS ({SUBMISSIONS}), f AS (SELECT *, first_value(hash) OVER (PARTITION BY producer, job_id ORDER BY turn, hash) AS first_hash, row_number() OVER (PARTITION BY producer, job_id ORDER BY turn, hash) AS r FROM s)
SELECT producer, job_id, turn, CASE WHEN r = 1 THEN 'accepted' WHEN hash = first_hash THEN 'duplicate' ELSE 'conflict' END AS outcome FROM f""")
def receipt_idempotency(t):
    w = Window.partitionBy("producer", "job_id").orderBy("turn", "hash")
    s = submissions(t).withColumns({"first_hash": F.first("hash").over(w), "r": F.row_number().over(w)})
    return s.select("producer", "job_id", "turn", F.when(F.col("r") == 1, "accepted").when(F.col("hash") == F.col("first_hash"), "duplicate").otherwise("conflict").alias("outcome"))


@query(f"SELECT job_id, count(*) AS submitted, CASE WHEN bool_or(producer = 'system') THEN 'needs_review' WHEN count(*) > 2 THEN 'accepted_partial' ELSE 'accepted' END AS state FROM ({SUBMISSIONS}) GROUP BY job_id")
def ack_state(t):
    n = F.count(F.lit(1))
    return submissions(t).groupBy("job_id").agg(n.alias("submitted"), F.when(F.bool_or(F.col("producer") == "system"), "needs_review").when(n > 2, "accepted_partial").otherwise("accepted").alias("state"))


@query(f"SELECT job_id, count(*) FILTER (WHERE producer = 'user') AS entities, count(*) FILTER (WHERE producer = 'assistant') AS claims, CASE WHEN count(*) FILTER (WHERE producer = 'assistant') = 0 THEN 'no_claims' WHEN count(*) FILTER (WHERE producer = 'user') > 1 THEN 'ambiguous_entities' ELSE 'ready_for_validation' END AS disposition FROM ({SUBMISSIONS}) GROUP BY job_id")
def receipt_disposition(t):
    of = lambda p: F.count_if(F.col("producer") == p)
    return submissions(t).groupBy("job_id").agg(of("user").alias("entities"), of("assistant").alias("claims"), F.when(of("assistant") == 0, "no_claims").when(of("user") > 1, "ambiguous_entities").otherwise("ready_for_validation").alias("disposition"))


@query("""SELECT conv_id AS job_id, turn, CASE WHEN text = '' THEN 'empty_body' WHEN role NOT IN ('user', 'assistant') THEN 'producer_not_allowed' WHEN strlen(text) > 600 THEN 'body_too_large' WHEN turn > 5 THEN 'sequence_out_of_range' END AS reason FROM conversations""")
def receipt_reject_reason(t):
    rules = {"empty_body": F.col("text") == "", "producer_not_allowed": ~F.col("role").isin("user", "assistant"), "body_too_large": F.octet_length("text") > 600, "sequence_out_of_range": F.col("turn") > 5}
    return t.conversations.select(F.col("conv_id").alias("job_id"), "turn", quality.first_violation(rules).alias("reason"))
