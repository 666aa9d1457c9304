"""Column functions of the public-record domain; every one is an expression of Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspine.functions import vocabularies

# Letters with marks and what stands below the mark, one for one.
MARKED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"


def normalize_person_name(name: Column, strict: bool = False) -> Column:
    """Lower-case ASCII words. Marks are taken off; strict leaves a space where a mark stood, as decomposition would."""
    s = F.translate(name, MARKED, PLAIN) if not strict else F.regexp_replace(name, f"([{MARKED}])", "$1 ")
    s = F.translate(s, MARKED, PLAIN) if strict else s
    s = F.regexp_replace(s, "[\"“”']", "")
    return F.lower(F.trim(F.regexp_replace(s, "[^a-zA-Z0-9]+", " ")))


def slug(text: Column, mode: str = "dash", limit: int | None = None) -> Column:
    """mode dash: words joined by '-'; underscore: by '_' ; token: trimmed lower case, at most `limit` characters."""
    joiner = "_" if mode == "underscore" else "-"
    s = F.lower(F.trim(F.translate(text, MARKED, PLAIN)))
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", joiner), f"^{joiner}+|{joiner}+$", "")
    return F.substring(s, 1, limit) if limit else s


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name (RFC 4122) from sha1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def value_hash(field: Column, value: Column) -> Column:
    return F.sha2(F.concat(field, F.decode(F.lit(bytearray(b"\0")), "UTF-8"), F.coalesce(value, F.lit(""))), 256)


def json_identity(prefix: str, **fields: Column) -> Column:
    """prefix + sha256 of compact JSON with sorted keys; values are strings."""
    parts = [F.concat(F.lit(f'"{k}":"'), v.cast("string"), F.lit('"')) for k, v in sorted(fields.items())]
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256))


def iso_from_us_date(text: Column) -> Column:
    """m/d/yy (20yy) or m/d/yyyy to a date; null if it isn't one."""
    part = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd")


def name_parts(name: Column) -> Column:
    """'Last, First M.' or 'First M. Last' to a struct of first, last, display."""
    comma = F.contains(name, F.lit(","))
    last = F.when(comma, F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    first = F.when(comma, F.trim(F.split_part(name, F.lit(","), F.lit(2)))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), 1))
    display = F.when(comma, F.concat_ws(" ", first, last)).otherwise(F.trim(name))
    return F.struct(first.alias("first"), last.alias("last"), display.alias("display"))


def party(text: Column) -> Column:
    """The party that a registry's spelling begins with, or its letter; other texts as they are, without surplus spaces."""
    t = F.lower(text)
    return (
        F.when(t.startswith("republican") | (t == "r"), "Republican").when(t.startswith("democrat") | (t == "d"), "Democratic").when(t.startswith("no party"), "No Party Affiliation")
        .when(t.startswith("independent") | (t == "i"), "Independent").when(t == "", None).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    )


def district(text: Column) -> Column:
    t = F.lower(F.trim(text))
    digits = F.regexp_extract(t, r"(\d+)", 1)
    return F.when(t.contains("at large") | t.contains("at-large"), "AL").when(t.contains("delegate"), "DEL").when(t.contains("resident commissioner"), "RC").when(digits != "", digits)


def interval_seconds(text: Column) -> Column:
    """'24h', '7d', '15m', '30s' to seconds."""
    n = F.regexp_extract(text, r"^(\d+)[smhd]$", 1)
    unit = F.element_at(F.create_map(F.lit("s"), F.lit(1), F.lit("m"), F.lit(60), F.lit("h"), F.lit(3600), F.lit("d"), F.lit(86400)), F.regexp_extract(text, r"^\d+([smhd])$", 1))
    return F.when(n != "", n.cast("long") * unit)


# Named entities and their characters.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“"}


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as their characters, in one pass; unknown ones and impossible numbers stay as they are."""
    entity = "&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]+);"

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, f"^{entity}", 1))
        code = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 12), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 12)).try_cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(code == 160, " ").when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(vocabularies.look_up(name, ENTITIES))
        return F.when(char.isNotNull(), F.concat(char, F.regexp_replace(part, f"^{entity}", ""))).otherwise(part)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, f"(?={entity})"), one), "")).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: without scripts, styles and tags, entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def links(html: Column) -> Column:
    """href values of anchors that have one, wherever it stands in the tag and however it is quoted, decoded, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    part = lambda tag, i: F.regexp_extract(tag, r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i)
    return F.filter(F.transform(tags, lambda tag: decode_entities(F.trim(F.concat(part(tag, 1), part(tag, 2), part(tag, 3))))), lambda x: x != "")


def humanize(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def initials(name: Column) -> Column:
    return F.array_join(F.slice(F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.upper(F.substring(w, 1, 1))), 1, 2), "")


def looks_like_person_name(text: Column) -> Column:
    """Two to six capitalised words of Latin letters (or Jr., Sr., II to IV) that are no vacancy and no title of a site."""
    t = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r",+\s*$", "")
    words = F.split(t, " ")
    word = lambda w: w.rlike(r"^[A-Z][A-Za-z.'’-]*$") | w.rlike(r"(?i)^(Jr\.?|Sr\.?|II|III|IV)$")
    titled = t.rlike(r"(?i)^(vacant|tbd|to be determined)$") | t.rlike("(?i)welcome|official website|^home$|state of florida$")
    return F.size(words).between(2, 6) & ~titled & F.forall(words, word)


def merge_external_ids(old: Column, new: Column) -> Column:
    """Map union; the new value of a key wins."""
    keep = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(keep, new)


def first_external_id(ids: Column, priority: list[str]) -> Column:
    """The value of the first key of priority that the map has."""
    return F.get(F.filter(F.transform(F.array(*map(F.lit, priority)), lambda k: F.try_element_at(ids, k)), lambda v: v.isNotNull()), F.lit(0))


def excerpt(text: Column, needle: Column, around: int = 100) -> Column:
    """Struct of the first hit's UTF-8 byte offset and the text around it; nulls where there is none."""
    at = F.instr(text, needle)
    start = F.greatest(at - around, F.lit(1))
    hit = at > 0
    return F.struct(F.when(hit, F.octet_length(F.substring(text, F.lit(1), at - 1))).alias("byte_offset"), F.when(hit, F.substring(text, start, at - start + F.char_length(needle) + around)).alias("excerpt"))


def first_spellings(words: Column) -> Column:
    """The words that are not empty, each once whatever its case: in its first spelling, in order. Null has none.

    Words are sorted in their own row and not shuffled, so a text's work is a little more than its length.
    """
    keyed = F.transform(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: x != ""), lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("pos"), x.alias("word")))
    first = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["key"] != x["key"], F.lit(True)))
    firsts = F.flatten(F.transform(F.array(F.array_sort(keyed)), first))  # the sorted words are bound once
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word")))), lambda x: x["word"])


def seat_key(family: Column, district_number: Column, seat_class: Column) -> Column:
    """Key of a permanent seat from its family and district, or from its class for the federal senate."""
    dashed = F.replace(family, F.lit("_"), F.lit("-"))
    county = F.when((family == "commission") & district_number.isNotNull(), F.concat(F.lit("us-fl-miami-dade-county-commissioner-district-"), district_number)).otherwise(F.concat(F.lit("us-fl-miami-dade-"), dashed))
    return (
        F.when(family == "US Senate", F.concat(F.lit("us-fl-senate-"), F.replace(F.lower(seat_class), F.lit(" "), F.lit("-"))))
        .when(family.isin("commission", "clerk_of_court"), county)
        .otherwise(F.concat_ws("-district-", F.concat(F.lit("us-fl-"), dashed), district_number))
    )


def official_links(html: Column, base: Column, most: int = 20) -> Column:
    """base and the https links to official hosts, without query and fragment, once each, in order."""
    found = F.filter(F.regexp_extract_all(html, F.lit(r"""https?://[^\s"'<>]+"""), F.lit(0)), lambda x: x.startswith("https:"))
    host = lambda x: F.lower(F.regexp_extract(x, r"^https://([^/?#]+)", 1))
    path = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^https://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/"))
    official = lambda h: reduce(lambda a, p: a | h.contains(p), vocabularies.OFFICIAL_HOST_PARTS, h.endswith(".gov") | h.endswith(".us"))
    kept = F.transform(F.filter(found, lambda x: official(host(x))), lambda x: F.concat(F.lit("https://"), host(x), path(x)))
    return F.slice(F.array_distinct(F.concat(F.array(base), kept)), 1, most)


def canonical_url(href: Column, base: Column) -> Column:
    """href joined to its page's address, with a lower-case host, single slashes and no fragment; null for no web address."""
    raw = F.trim(href)
    joined = (
        F.when(raw.rlike("^(mailto:|tel:|javascript:|#)") | (raw == ""), F.lit(None)).when(raw.rlike("^[a-z]+://"), raw)
        .when(raw.startswith("//"), F.concat(F.regexp_extract(base, "^[a-z]+:", 0), raw)).when(raw.startswith("/"), F.concat(F.regexp_extract(base, "^[a-z]+://[^/]+", 0), raw))
        .otherwise(F.concat(F.regexp_extract(base, "^([a-z]+://.*/)", 1), raw))
    )
    path = F.regexp_replace(F.regexp_extract(joined, "^https?://[^/?#]+([^?#]*)", 1), "/{2,}", "/")
    whole = F.concat(F.regexp_extract(joined, "^https?://", 0), F.lower(F.regexp_extract(joined, "^https?://([^/?#]+)", 1)), F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), F.regexp_extract(joined, r"(\?[^#]*)", 1))
    return F.when(joined.rlike("^https?://[^/?#]"), whole)
