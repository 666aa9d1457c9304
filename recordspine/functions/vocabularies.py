"""Names that must equal those of stored data, each as a plain table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Office types and their classes; a class's contract has the class's name.
OFFICE_CLASSES = (
    "STATE_GOVERNOR", "STATE_EXECUTIVE", "STATE_SENATOR", "STATE_REPRESENTATIVE", "COUNTY_COMMISSIONER", "SHERIFF", "MAYOR", "CITY_COUNCIL_MEMBER", "SCHOOL_BOARD_MEMBER", "JUDGE",
    "SPECIAL_DISTRICT_MEMBER",
)
CLASS_OF_OFFICE = {
    "governor": "STATE_GOVERNOR", "state_governor": "STATE_GOVERNOR", "attorney_general": "STATE_EXECUTIVE", "chief_financial_officer": "STATE_EXECUTIVE", "cfo": "STATE_EXECUTIVE",
    "agriculture_commissioner": "STATE_EXECUTIVE", "commissioner_of_agriculture": "STATE_EXECUTIVE", "lieutenant_governor": "STATE_EXECUTIVE", "secretary_of_state": "STATE_EXECUTIVE",
    "state_senator": "STATE_SENATOR", "state_representative": "STATE_REPRESENTATIVE", "county_commissioner": "COUNTY_COMMISSIONER", "sheriff": "SHERIFF", "mayor": "MAYOR", "county_mayor": "MAYOR",
    "city_council_member": "CITY_COUNCIL_MEMBER", "school_board_member": "SCHOOL_BOARD_MEMBER", "judge": "JUDGE", "special_district_member": "SPECIAL_DISTRICT_MEMBER",
}

# Capabilities by the queue that runs them, and those that are ready.
CAPABILITIES_OF_QUEUE = {
    "ingest": "seat_discovery jurisdiction_discovery officeholder_discovery seat_structure_refresh portrait_discovery contact_discovery social_account_discovery committee_membership",
    "monitor": "vacancy_check term_refresh election_calendar_discovery candidate_filing_check candidate_discovery candidate_status_refresh ballot_qualification_check election_results_check "
    "election_certification_check source_health change_detection source_discovery",
    "validate": "identity_resolution relationship_conflict ethics_integrity entity_resolution contradiction_check evidence_validation completeness_audit publication_gate",
    "heavy": "biography_research education_research career_research prior_office_research legislative_activity executive_action statement_collection promise_collection "
    "public_position_collection campaign_finance financial_disclosure business_interest asset_disclosure large_pdf_parse gis_parse browser_render",
}
QUEUE_OF_CAPABILITY = {c: q for q, names in CAPABILITIES_OF_QUEUE.items() for c in names.split()}
READY_CAPABILITIES = (
    "officeholder_discovery source_health change_detection evidence_validation entity_resolution identity_resolution publication_gate election_calendar_discovery source_discovery "
    "seat_discovery jurisdiction_discovery candidate_discovery candidate_status_refresh portrait_discovery completeness_audit"
).split()

# The parser family of a source type; others are PDF_DIRECTORY.
FAMILY_OF_SOURCE = {
    "html_directory": "HTML_DIRECTORY", "html_detail_page": "HTML_DETAIL", "json_api": "JSON_API", "campaign_finance_api": "JSON_API", "legislative_api": "JSON_API", "xml_feed": "XML_FEED",
    "csv": "CSV", "official_profile_page": "OFFICIAL_PROFILE", "election_filing_page": "ELECTION_PORTAL", "large_pdf": "PDF_DETAIL",
}

# Hosts of social networks, and host parts of official sites.
PLATFORM_OF_HOST = {
    "x.com": "X", "twitter.com": "X", "facebook.com": "Facebook", "instagram.com": "Instagram", "youtube.com": "YouTube", "youtu.be": "YouTube", "tiktok.com": "TikTok",
    "linkedin.com": "LinkedIn", "threads.net": "Threads", "bsky.app": "Bluesky", "truthsocial.com": "Truth Social", "telegram.me": "Telegram", "t.me": "Telegram",
}
OFFICIAL_HOST_PARTS = ("broward", "pbc", "flsenate", "flhouse", "flgov", "pbcelections", "browardsoe", "dos.fl")

# External identifiers, the strongest first.
EXTERNAL_IDS = (
    "official_source_id", "source_person_id", "fec", "fec_id", "bioguide", "state_id", "state_candidate_id", "legislative_id", "election_filing_id", "ocd_person", "wikidata", "ballotpedia",
)


def look_up(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The value of a key in a small table of literals."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key], F.lit(default))


def office_class(office_type: Column) -> Column:
    """By the office table, else the type itself spelled like a class, else STATE_EXECUTIVE."""
    spelled = F.regexp_replace(F.upper(office_type), r"[\s-]+", "_")
    return F.coalesce(look_up(office_type, CLASS_OF_OFFICE), F.when(spelled.isin(*OFFICE_CLASSES), spelled), F.lit("STATE_EXECUTIVE"))
