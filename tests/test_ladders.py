import itertools

from pyspark.sql import functions as F

from recordspine.functions import ladders


def step(state, field, matched, ev, contra, portrait, tier, certified):
    """One move of the state machine, as a loop would take it."""
    if state == "collected_unreviewed":
        return "extracted"
    if state == "extracted":
        return "entity_match_pending"
    if state == "entity_match_pending":
        return "evidence_pending" if matched else state
    if state == "evidence_pending":
        return "verification_pending" if ev else state
    if state == "verification_pending":
        if contra:
            return "conflict"
        if field == "portrait":
            return state if portrait else "rejected"
        if not ev:
            return "checked_no_authoritative_result"
        return "verified" if tier and certified and matched and ev else state
    return state


def test_next_state_is_the_fixed_point_of_the_step(spark):
    flags = list(itertools.product([False, True], repeat=6))
    rows = [(s, f, *x) for s in ladders.CLAIM_MOVES for f in ("contact", "portrait") for x in flags]
    names = ["state", "field", "matched", "ev", "contra", "portrait", "tier", "certified"]
    df = spark.createDataFrame(rows, names)
    got = df.withColumn("out", ladders.next_claim_state(*(F.col(c) for c in names))).collect()
    for r in got:
        state = r["state"]
        for _ in range(8):
            state = step(state, *(r[c] for c in names[1:]))
        assert r["out"] == state, r


def test_presence_and_bucket(spark):
    rows = [(None, None, None), ("verified", "", "shown"), ("verified", "", ""), ("verified", None, None), ("not_collected", "x", None), ("checked_no_authoritative_result", "x", None), ("stale", "x", None)]
    df = spark.createDataFrame(rows, "state string, n string, d string")
    got = df.select(ladders.claim_presence(F.col("state"), F.col("n"), F.col("d")), ladders.verification_bucket(F.col("state")), ladders.has_value(F.col("n"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        ("MISSING", "NOT_CHECKED", False), ("PRESENT", "VERIFIED", False), ("UNKNOWN", "VERIFIED", False), ("UNKNOWN", "VERIFIED", False), ("MISSING", "PENDING", True),
        ("CHECKED_NO_AUTHORITATIVE_RESULT", "PENDING", True), ("PRESENT", "STALE", True)]


def test_field_evaluation_rules_in_order(spark):
    # required, implemented, state, filled, structural, evidence, contradiction -> presence, action
    cases = [
        ((True, True, "verified", True, False, True, True), ("PRESENT", "contradiction")), ((True, True, "stale", False, False, False, False), ("PRESENT", "refresh")),
        ((True, True, "checked_no_authoritative_result", False, False, False, False), ("CHECKED_NO_AUTHORITATIVE_RESULT", "none")), ((True, True, "verified", True, False, False, False), ("PRESENT", "verify")),
        ((True, True, "verified", True, False, True, False), ("PRESENT", "none")), ((False, True, "verified", True, False, False, False), ("PRESENT", "none")), ((True, True, None, False, True, False, False), ("PRESENT", "none")),
        ((True, False, None, False, False, False, False), ("MISSING", "close_not_implemented")), ((True, True, None, False, False, False, False), ("MISSING", "collect")), ((True, True, "not_collected", True, False, True, False), ("MISSING", "collect"))]
    names = ["required", "implemented", "state", "filled", "structural", "ev", "contra"]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, required boolean, implemented boolean, state string, filled boolean, structural boolean, ev boolean, contra boolean")
    c = {n: F.col(n) for n in names}
    out = ladders.field_evaluation(F.lit("contact"), c["required"], F.lit(False), c["implemented"], c["state"], c["filled"], c["structural"], c["ev"], c["contra"], F.lit("PRESENT"))
    assert [tuple(r["o"]) for r in df.select("i", out.alias("o")).orderBy("i").collect()] == [c[1] for c in cases]


def test_coverage_and_dataset_states(spark):
    lit = F.lit
    cover = lambda **k: ladders.coverage_state(*(k.get(n, d) if not isinstance(k.get(n, d), (int, bool, str, type(None))) else lit(k.get(n, d)) for n, d in (("finite", True), ("expected", 3), ("accounted", 3), ("missing", 0), ("cutoff", "2024"), ("audited", True), ("families", 2), ("passes", 2), ("leads", 0), ("reopened", False), ("cap", False), ("src", False))))
    cases = [cover(), cover(missing=1), cover(accounted=2, missing=1), cover(audited=False), cover(reopened=True), cover(cap=True), cover(src=True), cover(finite=False), cover(finite=False, families=1), cover(finite=False, leads=2)]
    got = spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(cases))).first()
    assert list(got) == ["RECONCILED_THROUGH", "REOPENED", "IN_PROGRESS", "IN_PROGRESS", "REOPENED", "CAPABILITY_BLOCKED", "SOURCE_BLOCKED", "SEARCH_SATURATED_AS_OF", "IN_PROGRESS", "IN_PROGRESS"]
    d = [ladders.dataset_state(lit(i), lit(e).cast("int"), lit(c), lit(m)) for i, e, c, m in ((False, 1, 1, 0), (True, 3, 0, 3), (True, 3, 3, 0), (True, None, 3, 0), (True, 3, 2, 1))]
    assert list(spark.range(1).select(*(x.alias(str(i)) for i, x in enumerate(d))).first()) == ["checked_no_authoritative_result", "not_collected", "coverage_complete_for_defined_scope", "incomplete", "incomplete"]


def test_small_ladders(spark):
    lit = F.lit
    row = spark.range(1).select(
        ladders.url_authority(lit("https://www.senate.gov/x")), ladders.url_authority(lit("http://a.gov")), ladders.url_authority(lit("https://images.google.com/i")), ladders.url_authority(lit("nonsense")), ladders.url_authority(lit("https://notgov.org")),
        ladders.authority_tier(lit(" Official ")), ladders.authority_tier(lit(None).cast("string")), ladders.occupancy_row_status(lit("former"), lit(False)), ladders.occupancy_row_status(lit("unknown"), lit(True)), ladders.occupancy_row_status(lit(None).cast("string"), lit(True)),
        ladders.document_kind(lit("%PDF-1.4"), lit("text/html")), ladders.document_kind(lit("  {\"a\":1}"), lit(None).cast("string")), ladders.document_kind(lit("a,b"), lit("text/plain")), ladders.backoff_ms(lit(3), 1000, 900000), ladders.refresh_seconds(lit("HIGH"), lit(45)), ladders.refresh_seconds(lit("HIGH"), lit(46)),
        ladders.capability_state(lit("READY"), lit(0), lit(2)), ladders.alignment_state(lit(False), lit(1), lit(0), lit(1))).first()
    assert list(row) == [
        "official_gov_host", "insecure_url", "search_engine_image_rejected", "invalid_url", "not_official_gov_host", "TIER_1_PRIMARY_OFFICIAL", "TIER_5_DISCOVERY_ONLY", "completed", "vacant", "completed",
        "small_pdf", "json", "csv", 4171, 900, 3600, "FAILED", "CONFLICTING_EVIDENCE"]
