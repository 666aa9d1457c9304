"""Rosters from directory pages, and the gate that a page's whole record set passes or fails: seats given twice, district and
address at odds, too few or too many records. A refused set is told apart with its reasons; no part of it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspine import functions as fn

# What ends a term before its time, and parties as directories print them.
INACTIVE = ["resigned", "deceased", "removed", "expelled"]
PARTIES = "Republican|Democrat(?:ic)?|No Party Affiliation|Independent"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"


def _href(tag: Column) -> Column:
    """The first address that an anchor in the text has."""
    return F.get(fn.links(tag), F.lit(0))


def _none(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def seat_tables(pages: DataFrame, key: str, html: str, codes: dict[str, str]) -> DataFrame:
    """(key, table, row, unit, state, district, name, former_name, href, party, room, phone, committees, vacant) of tables of members.

    A table's rows belong to the state that its caption names, or else to the last row above them that names a state alone (codes:
    names and codes). Cells: district, member, party, room, phone, committees with bars between them. A row that says vacancy has no
    name, and the former holder in former_name; a row with neither link nor vacancy, with less than three cells or without a state
    gives none. unit is state|district. Null pages give none.
    """
    code = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    t = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "body"))
    # What stands beside a generator is computed for each row that it makes, from a copy of its input: so the caption is made into
    # a row's value first, and a table's text goes with none of its rows. Rows are dealt out, as one table may have very many.
    caption = fn.html_text(F.regexp_extract("body", r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    rows = F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    t = t.select(key, "table", F.inline(F.array(F.struct(caption.alias("caption"), rows.alias("rows"))))).select(key, "table", "caption", F.posexplode("rows").alias("row", "r"))
    t = t.repartition(key, "table", "row")
    t = t.withColumn("raw", F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    t = t.withColumn("cells", F.transform("raw", fn.html_text))
    heading = F.when(F.size("cells") == 1, F.get("cells", F.lit(0)))
    above = Window.partitionBy(key, "table").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("state", F.coalesce(F.last(F.try_element_at(code, heading), ignorenulls=True).over(above), F.try_element_at(code, F.col("caption"))))
    cell = lambda i: _none(F.get("cells", F.lit(i)))
    vacant = F.exists("cells", lambda x: F.lower(x).contains("vacancy"))
    link = F.coalesce(_href(F.get("raw", F.lit(1))), _href(F.col("r")))
    label = F.lower(F.get("cells", F.lit(0)))
    t = t.select(key, "table", "row", "state", "cells", vacant.alias("vacant"), _none(link).alias("href")).where((F.size("cells") >= 3) & F.col("state").isNotNull() & ~label.isin("", "district", "district name"))
    t = t.where(F.col("href").isNotNull() | F.col("vacant"))
    district = F.coalesce(F.regexp_replace(fn.district(cell(0)), "^0+(?=[0-9])", ""), cell(0))
    former = _none(F.regexp_replace(cell(1), r"(?i)\s*-?\s*vacancy\s*$", ""))
    committees = F.filter(F.transform(F.split(F.coalesce(cell(5), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return t.select(key, "table", "row", F.concat_ws("|", "state", district).alias("unit"), "state", district.alias("district"), F.when(~F.col("vacant"), cell(1)).alias("name"), F.when(F.col("vacant"), former).alias("former_name"), "href", cell(2).alias("party"), cell(3).alias("room"), cell(4).alias("phone"), committees.alias("committees"), "vacant")


def term_entries(pages: DataFrame, key: str, html: str, address: str) -> DataFrame:
    """(key, pos, unit, name, party, counties, start, end, status, active, href, member_id) of links whose text is a whole entry:
    'Name Party - District: 7 Counties 11/05/24 - 11/03/26 (Resigned)'.

    address: a pattern that the href matches as a whole. An entry is active unless its status names an end; of active entries with
    one address only the first of a page counts. Texts that are no entry give none. unit is the district.
    """
    a = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(f"({ANCHOR})"), F.lit(1))).alias("pos", "a")).select(key, "pos", _href(F.col("a")).alias("href"), fn.html_text(F.col("a")).alias("said"))
    entry = rf"(?i)^(.+?)\s+({PARTIES})\s+[—-]\s*District:\s*(\d{{1,3}})\b\s*(.*?)\s+(\d\d/\d\d/\d\d)\s*-\s*(\d\d/\d\d/\d\d)(?:\s*\(([^)]+)\))?$"
    part = lambda i: _none(F.regexp_extract("said", entry, i))
    rows = a.where(F.col("href").rlike(f"^(?:{address})$") & F.col("said").rlike(entry))
    active = ~F.coalesce(F.lower(part(7)).rlike("|".join(INACTIVE)), F.lit(False))
    rows = rows.select(key, "pos", F.regexp_replace(part(3), "^0+(?=[0-9])", "").alias("unit"), part(1).alias("name"), fn.party(part(2)).alias("party"), part(4).alias("counties"), part(5).alias("start"), part(6).alias("end"), part(7).alias("status"), active.alias("active"), "href", _none(F.regexp_extract("href", "(?i)[?&]memberid=([^&#]*)", 1)).alias("member_id"))
    first = F.min(F.when(F.col("active"), F.col("pos"))).over(Window.partitionBy(key, "href"))
    return rows.withColumn("_first", first).where(~F.col("active") | (F.col("pos") == F.col("_first"))).drop("_first")


def district_entries(pages: DataFrame, key: str, html: str, path: str) -> DataFrame:
    """(key, pos, unit, name, party, counties, href, matches) of links whose address ends in a district, with the text up to the next.

    path: the pattern before the district's number. Only an entry whose text names a party and what the district consists of counts,
    so that former members fall out; of equal addresses the first one. matches is false where a number before the party differs from
    the address's.
    """
    anchor = rf"""<a\s(?:[^>]*?\s)?href\s*=\s*["']{path}\d"""
    parts = pages.select(key, F.posexplode(F.split(F.col(html), f"(?i)(?={anchor})")).alias("pos", "part")).where(F.col("part").rlike(f"(?i)^{anchor}"))
    tag = F.regexp_extract("part", ANCHOR, 0)
    a = parts.select(key, "pos", _href(tag).alias("href"), _none(fn.html_text(tag)).alias("name"), fn.html_text(F.regexp_replace("part", rf"^{ANCHOR}", "")).alias("said"))
    party = _none(F.regexp_extract("said", rf"(?i)\b({PARTIES})\b", 1))
    counties = _none(F.regexp_extract("said", r"(?i)\b(Consists of\s+.+?)(?=\s+(?:Track(?:er)?|Former Senators|Home\b)|$)", 1))
    seen = F.regexp_extract(F.regexp_extract("said", rf"(?i)^(.*?)\b(?:{PARTIES})\b", 1), r"\b(\d{1,3})\b", 1).try_cast("int")
    unit = F.regexp_extract("href", rf"(?i)^{path}0*(\d+)", 1)
    rows = a.select(key, "pos", unit.alias("unit"), "name", fn.party(party).alias("party"), counties.alias("counties"), "href", F.coalesce(seen == unit.cast("int"), F.lit(True)).alias("matches")).where("name IS NOT NULL AND party IS NOT NULL AND counties IS NOT NULL")
    return rows.withColumn("_first", F.min("pos").over(Window.partitionBy(key, "href"))).where("pos = _first").drop("_first")


def gate(records: DataFrame, manifest: DataFrame, key: str, unit: str = "unit", matches: Column | None = None) -> DataFrame:
    """manifest (key, expected_minimum, expected_maximum) with n, repeated_units, status and reasons: a set passes whole or not at all.

    reasons, in this order: repeated_unit, mismatch (a record whose `matches` is false), too_few, too_many. A key without records
    has n 0. Counts are summed by key and unit first, so that a large set is no single task.
    """
    odd = F.count_if(~matches) if matches is not None else F.lit(0).cast("long")
    units = records.groupBy(key, unit).agg(F.count(F.lit(1)).alias("_k"), odd.alias("_odd"))
    sums = units.groupBy(key).agg(F.sum("_k").alias("_n"), F.count_if(F.col("_k") > 1).alias("_repeated"), F.sum("_odd").alias("_odd"))
    out = manifest.join(sums, key, "left")
    n, repeated = F.coalesce("_n", F.lit(0)), F.coalesce("_repeated", F.lit(0))
    rules = {"repeated_unit": repeated > 0, "mismatch": F.col("_odd") > 0, "too_few": n < F.col("expected_minimum"), "too_many": n > F.col("expected_maximum")}
    reasons = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda x: x.isNotNull())
    return out.select(*manifest.columns, n.alias("n"), repeated.alias("repeated_units"), F.when(F.size(reasons) == 0, "accepted").otherwise("refused").alias("status"), reasons.alias("reasons"))


def accepted(records: DataFrame, gates: DataFrame, key: str) -> DataFrame:
    """The records of the sets that passed."""
    return records.join(gates.where("status = 'accepted'").select(key), key, "left_semi")
