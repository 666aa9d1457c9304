"""Decision ladders: ordered rules as one CASE expression each, over columns of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspine.functions.vocabularies import look_up

# Vocabularies and the legal moves between claim states.
CLAIM_MOVES = {
    "not_collected": ["collected_unreviewed", "source_found", "checked_no_authoritative_result"],
    "collected_unreviewed": ["source_found", "extracted", "rejected", "stale"],
    "source_found": ["extracted", "rejected", "stale"],
    "extracted": ["entity_match_pending", "rejected", "stale"],
    "entity_match_pending": ["evidence_pending", "rejected", "conflict", "stale"],
    "evidence_pending": ["verification_pending", "rejected", "stale"],
    "verification_pending": ["verified", "conflict", "rejected", "stale", "checked_no_authoritative_result"],
    "verified": ["stale", "conflict", "superseded"],
    "conflict": ["verification_pending", "rejected", "stale"],
    "rejected": [],
    "stale": ["collected_unreviewed"],
    "superseded": [],
    "checked_no_authoritative_result": ["collected_unreviewed", "stale"],
}
REFRESH_SECONDS = {"IMMUTABLE": (2592000, 604800), "LOW": (86400, 21600), "MEDIUM": (21600, 3600), "HIGH": (3600, 900), "ELECTION_REALTIME": (900, 300)}
SEARCH_HOSTS = ["google.com", "www.google.com", "images.google.com", "bing.com", "www.bing.com", "duckduckgo.com", "www.duckduckgo.com", "yahoo.com", "images.search.yahoo.com", "yandex.com", "baidu.com"]
LIVE_OCCUPANCY = ["current", "upcoming", "completed", "vacant", "acting", "disputed"]
STRUCTURAL_FIELDS = ["jurisdiction", "seat", "person", "occupancy", "monitoring"]


def in_list(c: Column, values) -> Column:
    return c.isin(*values)


def claim_presence(state: Column, normalized: Column, display: Column) -> Column:
    """Null state: no claim. An empty normalized value falls back to the display value."""
    value = F.coalesce(F.nullif(normalized, F.lit("")), F.nullif(display, F.lit("")))
    return (
        F.when(state.isNull(), "MISSING").when(state == "checked_no_authoritative_result", "CHECKED_NO_AUTHORITATIVE_RESULT")
        .when(state == "not_collected", "MISSING").when(value.isNotNull(), "PRESENT").otherwise("UNKNOWN")
    )


def verification_bucket(state: Column) -> Column:
    return F.when(state.isNull(), "NOT_CHECKED").when(state.isin("verified", "conflict", "stale", "rejected"), F.upper(state)).otherwise("PENDING")


def has_value(normalized: Column, display: Column) -> Column:
    """An empty normalized value hides the display value here, unlike in claim_presence."""
    return F.coalesce(F.length(F.trim(F.coalesce(normalized, display, F.lit("")))) > 0, F.lit(False))


def field_evaluation(field_key: Column, required: Column, open_ended: Column, implemented: Column, state: Column, filled: Column, structural: Column, has_evidence: Column, has_contradiction: Column, presence: Column, enumerable: Column | None = None, dataset_incomplete: Column | None = None) -> Column:
    """Struct of presence and action for one contract field of one subject."""
    out = lambda p, a: F.struct((p if isinstance(p, Column) else F.lit(p)).alias("presence"), F.lit(a).alias("action"))
    present = structural | (filled & F.coalesce(state != "not_collected", F.lit(False)))
    unproved = required & ~has_evidence & state.isNotNull() & ~field_key.isin(*STRUCTURAL_FIELDS)
    partial = (F.lit(False) if enumerable is None else enumerable) & implemented & (F.lit(False) if dataset_incomplete is None else dataset_incomplete)
    return (
        F.when(has_contradiction, out(presence, "contradiction")).when(state == "stale", out("PRESENT", "refresh"))
        .when(state == "checked_no_authoritative_result", out("CHECKED_NO_AUTHORITATIVE_RESULT", "none"))
        .when(present & unproved, out("PRESENT", "verify")).when(present & partial, out("PRESENT", "dataset_unit")).when(present, out("PRESENT", "none"))
        .when(~implemented, out("MISSING", "close_not_implemented")).otherwise(out("MISSING", "collect"))
    )


def next_claim_state(state: Column, field_key: Column, matched: Column, has_evidence: Column, has_contradiction: Column, portrait_allowed: Column, tier_one: Column, schema_certified: Column) -> Column:
    """Where the state machine comes to rest: the step function's fixed point in closed form."""
    pending = (
        F.when(has_contradiction, "conflict").when((field_key == "portrait") & ~portrait_allowed, "rejected").when(field_key == "portrait", "verification_pending")
        .when(~has_evidence, "checked_no_authoritative_result").when(tier_one & schema_certified & matched, "verified").otherwise("verification_pending")
    )
    from_evidence = F.when(has_evidence, pending).otherwise("evidence_pending")
    from_match = F.when(matched, from_evidence).otherwise("entity_match_pending")
    return (
        F.when(state.isin("collected_unreviewed", "extracted", "entity_match_pending"), from_match)
        .when(state == "evidence_pending", from_evidence).when(state == "verification_pending", pending).otherwise(state)
    )


# Tiers of sources and the words that registries use for them.
TIERS = {
    "TIER_1_PRIMARY_OFFICIAL": ["primary_official", "official"],
    "TIER_2_OFFICIAL_CAMPAIGN": ["official_campaign"],
    "TIER_3_PUBLIC_INSTITUTIONAL": ["public_institutional"],
    "TIER_4_SECONDARY_REVIEW": ["specialist_database", "secondary"],
}
DISCOVERY_TIER = "TIER_5_DISCOVERY_ONLY"
TIER_OF_WORD = {word: tier for tier, words in TIERS.items() for word in [tier.lower(), *words]}


def authority_tier(text: Column) -> Column:
    """A registry's word for a source as its tier; unknown words only help to discover."""
    return look_up(F.lower(F.trim(text)), TIER_OF_WORD, DISCOVERY_TIER)


def can_verify_alone(tier: Column) -> Column:
    return tier != DISCOVERY_TIER


def is_government_primary(tier: Column) -> Column:
    return tier == "TIER_1_PRIMARY_OFFICIAL"


def url_class(reason: Column) -> Column:
    """The rank of a picture by what url_authority says of its address."""
    return F.when(reason == "official_gov_host", "official_government_profile").otherwise("rejected")


def seat_table_status(occupied: Column, acting: Column) -> Column:
    return F.when(acting, "acting").when(occupied, "occupied").otherwise("vacant")


def url_authority(url: Column) -> Column:
    """Reason why a picture's or page's address may or may not stand as official."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))
    return (
        F.when(host == "", "invalid_url").when(~url.startswith("https:"), "insecure_url")
        .when(host.isin(*SEARCH_HOSTS) | host.endswith(".google.com") | host.endswith(".bing.com"), "search_engine_image_rejected")
        .when(~((host == "gov") | host.endswith(".gov")), "not_official_gov_host").otherwise("official_gov_host")
    )


def occupancy_row_status(raw: Column, vacant: Column) -> Column:
    return F.when(raw == "former", "completed").when(raw.isin("occupied", "unknown"), F.when(vacant, "vacant").otherwise("current")).when(raw.isin(*LIVE_OCCUPANCY), raw).otherwise(F.when(vacant, "completed").otherwise("current"))


def refresh_seconds(refresh_class: Column, days_to_election: Column) -> Column:
    near = F.coalesce(days_to_election, F.lit(999)) <= 45
    out = F.lit(None).cast("long")
    for name, (normal, close) in REFRESH_SECONDS.items():
        out = F.when(refresh_class == name, F.when(near, close).otherwise(normal).cast("long")).otherwise(out)
    return out


def dataset_state(implemented: Column, expected: Column, collected: Column, missing: Column) -> Column:
    met = F.coalesce((expected > 0) & (collected >= expected) & (missing == 0), F.lit(False))
    return F.when(~implemented, "checked_no_authoritative_result").when(collected == 0, "not_collected").when(met, "coverage_complete_for_defined_scope").otherwise("incomplete")


# The reasons of a scope's coverage and the state of each.
COVERAGE_STATE_OF = {
    "MATERIAL_MISS_REOPENED_SCOPE": "REOPENED",
    "REQUIRED_CAPABILITY_BLOCKED": "CAPABILITY_BLOCKED",
    "REQUIRED_SOURCE_FAMILY_BLOCKED": "SOURCE_BLOCKED",
    "FINITE_SCOPE_REQUIRES_EXPECTED_UNITS": "IN_PROGRESS",
    "ACCOUNTED_PLUS_MISSING_EXCEEDS_EXPECTED_UNITS": "REOPENED",
    "FINITE_SCOPE_REQUIRES_CUTOFF_AND_INDEPENDENT_AUDIT": "IN_PROGRESS",
    "FINITE_SCOPE_HAS_UNACCOUNTED_UNITS": "IN_PROGRESS",
    "FINITE_SCOPE_RECONCILED_TO_EXPLICIT_CUTOFF": "RECONCILED_THROUGH",
    "OPEN_SCOPE_REQUIRES_MULTIPLE_SOURCE_FAMILIES_AND_PASSES": "IN_PROGRESS",
    "OPEN_SCOPE_HAS_UNRESOLVED_LEADS": "IN_PROGRESS",
    "OPEN_SCOPE_REQUIRES_AUDIT_AND_AS_OF_BOUNDARY": "IN_PROGRESS",
    "OPEN_SCOPE_SATURATED_ONLY_FOR_DECLARED_AS_OF_BOUNDARY": "SEARCH_SATURATED_AS_OF",
}


def coverage_reason(finite: Column, expected: Column, accounted: Column, missing: Column, cutoff: Column, audited: Column, families: Column, passes: Column, leads: Column, reopened: Column, capability_blocked: Column, source_blocked: Column) -> Column:
    """Why a scope's coverage is in its state; null counts are 0, a null expected number is unknown."""
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    got, gap = zero(accounted), zero(F.coalesce(missing, expected - zero(accounted)))
    closed = F.coalesce(cutoff.isNotNull() & audited, F.lit(False))
    bounded = (
        F.when(expected.isNull(), "FINITE_SCOPE_REQUIRES_EXPECTED_UNITS").when(got + gap > expected, "ACCOUNTED_PLUS_MISSING_EXCEEDS_EXPECTED_UNITS").when(~closed, "FINITE_SCOPE_REQUIRES_CUTOFF_AND_INDEPENDENT_AUDIT")
        .when((got != expected) | (gap != 0), "FINITE_SCOPE_HAS_UNACCOUNTED_UNITS").otherwise("FINITE_SCOPE_RECONCILED_TO_EXPLICIT_CUTOFF")
    )
    unbounded = (
        F.when((zero(families) < 2) | (zero(passes) < 2), "OPEN_SCOPE_REQUIRES_MULTIPLE_SOURCE_FAMILIES_AND_PASSES").when(zero(leads) > 0, "OPEN_SCOPE_HAS_UNRESOLVED_LEADS")
        .when(~closed, "OPEN_SCOPE_REQUIRES_AUDIT_AND_AS_OF_BOUNDARY").otherwise("OPEN_SCOPE_SATURATED_ONLY_FOR_DECLARED_AS_OF_BOUNDARY")
    )
    blocked = F.when(reopened, "MATERIAL_MISS_REOPENED_SCOPE").when(capability_blocked, "REQUIRED_CAPABILITY_BLOCKED").when(source_blocked, "REQUIRED_SOURCE_FAMILY_BLOCKED")
    return blocked.when(finite, bounded).otherwise(unbounded)


def coverage_state(*inputs: Column) -> Column:
    """The state of coverage_reason, with the same inputs."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in COVERAGE_STATE_OF.items() for x in pair)), coverage_reason(*inputs))


def document_kind(head: Column, content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    text = F.ltrim(F.substring(head, 1, 200))
    return (
        F.when(head.startswith("%PDF-"), "small_pdf").when(kind == "application/json", "json").when(kind == "text/csv", "csv").when(kind.isin("text/html", "application/xhtml+xml"), "html").when(kind.isin("application/xml", "text/xml"), "xml")
        .when(text.startswith("{") | text.startswith("["), "json").when(text.startswith("<!DOCTYPE html") | text.startswith("<html") | text.startswith("<HTML"), "html").when(text.startswith("<?xml"), "xml")
        .when((kind == "text/plain") & text.contains(","), "csv").otherwise("unknown")
    )


def backoff_ms(failures: Column, base: int, cap: int, jitter: float = 0.1) -> Column:
    """Doubling from base to cap, and up to a share of jitter more by the number of failures."""
    exp = F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))))
    return (exp + F.floor(exp * jitter * ((failures % 7) / 7))).cast("long")


def blockers(**tests: Column) -> Column:
    """Names of the tests that hold, in their order."""
    return F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in tests.items())), lambda x: x.isNotNull())


def capability_state(declared: Column, good: Column, failed: Column) -> Column:
    return F.when(declared == "NOT_IMPLEMENTED", "NOT_IMPLEMENTED").when((good == 0) & (failed > 0), "FAILED").when(good == 0, declared).when(failed > 0, "DEGRADED").otherwise("ACTIVE")


def alignment_state(outside: Column, supports: Column, partial: Column, against: Column) -> Column:
    """Of a commitment's evidence; classifies evidence, never people."""
    return (
        F.when(outside, "OUTSIDE_OFFICEHOLDER_AUTHORITY").when((supports > 0) & (against > 0), "CONFLICTING_EVIDENCE").when(supports > 0, "EVIDENCE_SUPPORTS_FULFILLMENT")
        .when(against > 0, "EVIDENCE_SUPPORTS_NON_FULFILLMENT").when(partial > 0, "EVIDENCE_SUPPORTS_PARTIAL_FULFILLMENT").otherwise("INSUFFICIENT_EVIDENCE")
    )


def field_explanation(action: Column, presence: Column, field_key: Column, state: Column, capability: Column, open_ended: Column, missing: Column) -> Column:
    """Why field_evaluation came to its presence and action, in words."""
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    standing = (
        F.when(open_ended, "coverage_complete_for_defined_scope (never everything_on_the_internet_complete)")
        .when(state.isNotNull(), said("field contains information in state ", state)).otherwise("structural entity present")
    )
    wanting = F.when(state.isNotNull(), said("required field ", field_key, " is ", state, "; NULL/empty is not complete")).otherwise(said("required field ", field_key, " has no claim; NULL is not complete"))
    return (
        F.when(action == "contradiction", said("unresolved contradiction on ", field_key)).when(action == "refresh", "claim is stale and requires refresh")
        .when(presence == "CHECKED_NO_AUTHORITATIVE_RESULT", "checked; no authoritative result").when(action == "verify", "value present but evidence is insufficient for a material claim")
        .when(action == "dataset_unit", said("enumerable dataset incomplete; missing ", missing.cast("string"), " units"))
        .when(action == "close_not_implemented", said("NULL is not complete; capability ", capability, " is NOT_IMPLEMENTED"))
        .when(action == "collect", wanting).otherwise(standing)
    )


def claim_step(state: Column, field_key: Column, value: Column, matched: Column, has_evidence: Column, has_contradiction: Column, tier: Column, schema_certified: Column) -> Column:
    """Struct of the next state and the reason: one step; next_claim_state is where the steps end."""
    out = lambda to, reason: F.struct((to if isinstance(to, Column) else F.lit(to)).alias("to"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    address = url_authority(F.coalesce(value, F.lit("")))
    alone = is_government_primary(tier) & schema_certified & matched
    portrait = F.when(address != "official_gov_host", out("rejected", address)).otherwise(out("verification_pending", "portrait_gov_host_still_requires_review"))
    pending = (
        F.when(has_contradiction, out("conflict", "contradiction_open")).when(field_key == "portrait", portrait)
        .when(~has_evidence, out("checked_no_authoritative_result", "no_authoritative_evidence"))
        .when(alone, out("verified", "tier1_schema_unique_evidence")).otherwise(out("verification_pending", "evidence_backed_not_auto_verified"))
    )
    return (
        F.when(state == "collected_unreviewed", out("extracted", "payload_extracted")).when(state == "extracted", out("entity_match_pending", "ready_for_entity_match"))
        .when((state == "entity_match_pending") & matched, out("evidence_pending", "entities_matched")).when(state == "entity_match_pending", out(state, "entity_match_pending"))
        .when((state == "evidence_pending") & has_evidence, out("verification_pending", "evidence_present_unreviewed")).when(state == "evidence_pending", out(state, "evidence_missing"))
        .when(state == "verification_pending", pending).otherwise(out(state, "no_change"))
    )
