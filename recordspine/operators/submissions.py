"""Producers' submissions, one JSON text each: checked field by field, their references followed, and taken apart into tables.

A submission is one object with four objects (producer, job, cohort, currentness), lists of things, and six lists of candidates.
Checks are columns over the submission's own row and need no shuffle; references are sets in that row, and only unknown ones are
joined. Texts are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspine.sources.tables import written

# The fields of each part in their order, with (kind, least, most, required). Least and most are lengths of texts,
# numbers of list items, or the least number.
ROOT = {
    "contract_version": ("any", None, None, True),
    "producer": ("object", None, None, True),
    "job": ("object", None, None, True),
    "extraction_status": ("unreviewed", None, None, True),
    "capability": ("text", 1, 128, True),
    "cohort": ("object", None, None, True),
    "sources": ("list", None, None, True),
    "retrievals": ("list", None, None, True),
    "evidence": ("list", None, None, True),
    "entities": ("object", None, None, True),
    "claims": ("list", None, None, True),
    "relationships": ("list", None, None, True),
    "dataset_units": ("list", None, None, True),
    "gis_boundaries": ("list", None, None, True),
    "warnings": ("texts", 0, None, True),
    "gaps": ("texts", 0, None, True),
    "currentness": ("object", None, None, True),
    "monitoring_recommendations": ("list", None, None, True),
}
OBJECTS = {
    "producer": {"producer_id": ("text", 1, 128, True), "producer_version": ("text", 1, 128, True), "manifest_version": ("text", 0, 128, False), "execution_id": ("text", 0, 256, False)},
    "job": {"job_id": ("text", 1, 256, True), "research_work_identity": ("text", 16, 512, True), "research_reservation": ("object", None, None, False)},
    "job.research_reservation": {"reservation_id": ("text", 1, 256, True), "lease_expires_at": ("time", 1, 128, True)},
    "cohort": {"cohort_key": ("text", 1, 256, True), "state": ("text", 1, 128, True), "assignment_id": ("text", 0, 256, False)},
    "currentness": {"current_as_of": ("time", 1, 128, True), "cutoff": ("time", 1, 128, False), "source_universe": ("text", 0, 4096, False)},
    "entities": {
        "jurisdiction_candidates": ("list", None, None, True),
        "seat_candidates": ("list", None, None, True),
        "person_candidates": ("list", None, None, True),
        "occupancy_candidates": ("list", None, None, True),
        "election_candidates": ("list", None, None, True),
        "candidate_campaign_candidates": ("list", None, None, True),
    },
}
LISTS = {
    "sources": {"source_key": ("text", 1, 256, True), "source_url": ("url", 1, 4096, True), "source_name": ("text", 0, 512, False), "authority_tier": ("text", 0, 128, False)},
    "retrievals": {
        "source_key": ("text", 1, 256, True),
        "source_url": ("url", 1, 4096, True),
        "retrieved_at": ("time", 1, 128, True),
        "content_hash": ("hash", 64, 64, True),
        "mime_type": ("text", 1, 512, True),
        "byte_length": ("integer", 0, None, True),
        "method": ("text", 1, 256, True),
        "parser_version": ("text", 1, 256, True),
    },
    "evidence": {
        "evidence_key": ("text", 1, 256, True),
        "source_url": ("url", 1, 4096, True),
        "retrieved_at": ("time", 1, 128, True),
        "mime_type": ("text", 1, 512, True),
        "byte_length": ("integer", 0, None, True),
        "sha256": ("hash", 64, 64, True),
        "method": ("text", 1, 256, True),
        "parser_version": ("text", 1, 256, True),
        "content_base64": ("base64", 4, None, False),
        "locator": ("text", 0, 4096, False),
    },
    "claims": {
        "claim_key": ("text", 1, 512, True),
        "subject_candidate_key": ("text", 1, 512, True),
        "field_key": ("text", 1, 256, True),
        "value": ("any", None, None, True),
        "evidence_keys": ("texts", 1, None, True),
        "observed_at": ("time", 1, 128, False),
    },
    "relationships": {
        "subject_candidate_key": ("text", 1, 512, True),
        "object_candidate_key": ("text", 1, 512, True),
        "relationship_type": ("text", 1, 256, True),
        "direction": ("text", 0, 64, False),
        "amount": ("number", None, None, False),
        "period": ("text", 0, 256, False),
        "evidence_keys": ("texts", 1, None, True),
    },
    "dataset_units": {"dataset_key": ("text", 1, 256, True), "unit_key": ("text", 1, 512, True), "state": ("text", 1, 128, True), "evidence_keys": ("texts", 0, None, False)},
    "gis_boundaries": {
        "boundary_key": ("text", 1, 512, True),
        "source_url": ("url", 1, 4096, True),
        "effective_status": ("text", 1, 128, True),
        "effective_from": ("text", 10, 10, False),
        "effective_to": ("text", 10, 10, False),
        "geometry_sha256": ("hash", 64, 64, False),
        "evidence_keys": ("texts", 0, None, False),
    },
    "monitoring_recommendations": {"scope": ("text", 1, 256, True), "reason": ("text", 1, 4096, True), "next_check_at": ("time", 1, 128, False)},
}
CANDIDATE = {
    "candidate_key": ("text", 1, 512, True),
    "canonical_id_hint": ("text", 0, 256, False),
    "attributes": ("object", None, None, True),
    "evidence_keys": ("texts", 0, None, True),
    "identity_resolution_required": ("boolean", None, None, False),
}
UNREVIEWED = "extracted_unreviewed"

FIELDS = {"": ROOT, **OBJECTS, **LISTS, **{f"entities.{s}": CANDIDATE for s in OBJECTS["entities"]}}
TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "texts": "array<string>"}  # of table columns; all others are text


def _rules() -> Column:
    """The fields of every part as one literal map."""
    lit = lambda x, t: F.lit(x).cast(t)
    one = lambda name, r: F.struct(F.lit(name).alias("name"), F.lit(r[0]).alias("kind"), lit(r[1], "long").alias("least"), lit(r[2], "long").alias("most"), F.lit(r[3]).alias("required"))
    return F.create_map(*(x for part, fields in FIELDS.items() for x in (F.lit(part), F.array(*(one(n, r) for n, r in fields.items())))))


def _once(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """key and the columns, as the one row of an inlined list: a filter on them, moved below a projection, would read the text again."""
    return df.select(F.col(key), F.inline(F.array(F.struct(*columns))))


def _object(value: Column) -> Column:
    """The fields of an object, or null; much cheaper than to ask for the type of all that is in it."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _is_object(value: Column) -> Column:
    """Without a copy of what the object holds."""
    return F.try_variant_get(value, "$", "struct<_:boolean>").isNotNull()


def _is_list(value: Column) -> Column:
    """Without a copy of the items; those that are no booleans become nulls."""
    return F.try_variant_get(value, "$", "array<boolean>").isNotNull()


def _items(path: str, fields: str) -> Column:
    """Some fields of a list's items, straight from the text's variant _v: items aren't copied as variants of their own first."""
    kind = f"array<struct<{fields}>>"
    return F.coalesce(F.try_variant_get("_v", f"$.{path}", kind), F.array().cast(kind))


def _read(r: Column, value: Column) -> Column:
    """What the rules ask about a field, read once: its rule, whether it is there, type and text of a single value, broken kind of others."""
    single = ~r["kind"].isin("object", "list", "texts", "any")
    wrong = (
        F.when(r["kind"] == "object", F.when(~_is_object(value), "not_an_object"))
        .when(r["kind"] == "list", F.when(~_is_list(value), "not_a_list"))
        .when(r["kind"] == "texts", F.when(F.coalesce(F.exists(_list(value), lambda x: F.schema_of_variant(x) != "STRING"), F.lit(True)), "not_texts").when(F.size(_list(value)) < r["least"], "too_few"))
    )
    return F.struct(r.alias("r"), value.isNotNull().alias("there"), F.when(single, F.schema_of_variant(value)).alias("type"), F.when(single, F.try_variant_get(value, "$", "string")).alias("text"), wrong.alias("wrong"))


def _broken(f: Column) -> Column:
    """The rule that a field breaks, or null; f as read."""
    kind, text, number = f["r"]["kind"], f["text"], f["type"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    value = text.try_cast("double")
    in_text = (
        F.when(f["type"] != "STRING", "not_text").when(F.length(text) < f["r"]["least"], "too_short").when(F.length(text) > f["r"]["most"], "too_long").when(kind == "text", None)
        .when(kind == "url", F.when(~text.rlike(r"(?i)^https?://[^\s/?#]+\S*$"), "bad_url"))
        .when(kind == "time", F.when(text.try_cast("timestamp").isNull(), "bad_time"))
        .when(kind == "hash", F.when(~text.rlike("^[0-9a-fA-F]{64}$"), "bad_hash"))
        .otherwise(F.when(F.coalesce(F.base64(F.try_to_binary(text, F.lit("base64"))) != text, F.lit(True)), "bad_base64"))
    )
    return (
        F.when(~f["there"], F.when(f["r"]["required"], "required"))
        .when(kind.isin("text", "url", "time", "hash", "base64"), in_text)
        .when(kind == "unreviewed", F.when((f["type"] != "STRING") | (text != UNREVIEWED), "bad_status"))
        .when(kind == "boolean", F.when(f["type"] != "BOOLEAN", "not_boolean"))
        .when(kind == "number", F.when(~number, "not_a_number"))
        .when(kind == "integer", F.when(~number | (value != F.floor(value)) | (value < f["r"]["least"]), "not_a_count"))
        .otherwise(f["wrong"])
    )


def _parts(v: Column) -> Column:
    """array<struct<part, path, item>>: the submission itself, its objects where they are objects, and every item of its lists."""
    of = lambda part, path, item: F.struct(part.alias("part"), path.alias("path"), item.alias("item"))
    objects = [of(F.lit(p), F.lit(p), F.try_variant_get(v, f"$.{p}", "variant") if p else v) for p in ("", *OBJECTS)]
    objects = F.filter(F.array(*objects), lambda x: _is_object(x["item"]))

    def items(part: str) -> Column:
        held = F.coalesce(F.try_variant_get(v, f"$.{part}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(held, lambda x, i: of(F.lit(part), F.concat(F.lit(f"{part}["), i.cast("string"), F.lit("]")), x))

    return F.concat(objects, *(items(p) for p in FIELDS if p not in ("", *OBJECTS)))


def _right() -> str:
    """What the part and JSON text of an item look like that breaks no rule; keys of a variant are in order, so one pattern is enough.

    Right items may look otherwise (escapes, long lists, values in objects): such ones are read field by field, as wrong ones are.
    """
    plain = r'"[^"\\]*+"'
    some = lambda one, least: rf"{one}(?:,{one}){{0,50}}+" if least else rf"(?:{one}(?:,{one}){{0,50}}+)?+"
    day = r"(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
    kinds = {
        "url": r'"https?://[A-Za-z0-9.-]++(?:/[!#-\[\]-~]*+)?+"',
        "time": rf'"[1-9]\d{{3}}-{day}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\dZ"',
        "hash": r'"[0-9a-fA-F]{64}"',
        "base64": r'"(?:[A-Za-z0-9+/]{4}){0,50}(?:[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=|[A-Za-z0-9+/][AQgw]==)"',
        "integer": r"\d{1,15}+",
        "number": r"-?\d{1,15}+",
        "boolean": "(?:true|false)",
        "object": rf"\{{{some(f'{plain}:{plain}', 0)}\}}",
        "any": rf"(?:{plain}|-?\d{{1,15}}+|true|false|null|\[{some(plain, 0)}\])",
    }

    def value(kind: str, least: int | None, most: int | None) -> str:
        if kind == "text":
            return rf'"[^"\\]{{{least},{most}}}+"'
        if kind == "texts":
            return rf"\[{some(plain, least)}\]"
        return kinds[kind] if most is None or kind == "hash" else f'(?!"[^"]{{{most + 1}}}){kinds[kind]}'

    def fields(of: dict) -> str:
        return "".join(f'(?:"{n}":{value(kind, least, most)},?+){"" if required else "?+"}' for n, (kind, least, most, required) in sorted(of.items()))

    parts = {part: of for part, of in FIELDS.items() if not any(r[0] in ("list", "unreviewed") for r in of.values())}
    return "^(?:" + "|".join(rf"{part.replace('.', '[.]')}\{{{fields(of)}\}}" for part, of in parts.items()) + ")$"


def shape_violations(df: DataFrame, key: str, version: str, body: str = "body") -> DataFrame:
    """(key, path, rule): every field that a submission of this contract version must not hold, lacks, or holds in a wrong form.

    A text that is no JSON object, or null, gives not_an_object alone with an empty path; another contract version gives
    unsupported_contract alone. path is like evidence[3].sha256. A field that is there as JSON null is there: it has the wrong form.
    A submission that repeats a key in an object isn't read (not_an_object). Repeated rows of df are judged each for themselves.
    """
    v = _once(df, key, F.try_parse_json(body).alias("_v"))
    is_object = _is_object(F.col("_v"))
    said = F.try_variant_get("_v", "$.contract_version", "string")
    whole = F.when(~is_object, F.struct(F.lit("").alias("path"), F.lit("not_an_object").alias("rule"))).when(F.coalesce(said != version, F.lit(True)), F.struct(F.lit("contract_version").alias("path"), F.lit("unsupported_contract").alias("rule")))
    v = _once(v, key, F.col("_v"), whole.alias("_whole"))
    refused = v.where(F.col("_whole").isNotNull()).select(key, "_whole.*")
    x = v.where(F.col("_whole").isNull()).select(key, F.explode(_parts(F.col("_v"))).alias("x")).select(key, "x.*")
    x = x.where(F.col("part").isin("", "entities") | ~F.coalesce(F.concat("part", F.to_json("item")).rlike(_right()), F.lit(False)))
    x = _once(x.withColumn("_key", F.struct(key, "path")), "_key", _object(F.col("item")).alias("_fields"), F.element_at(_rules(), F.col("part")).alias("_rules")).select(f"_key.{key}", "_key.path", "_fields", "_rules")
    at = lambda name: F.concat_ws(".", F.nullif("path", F.lit("")), name)
    found = lambda name, rule: F.struct(at(name).alias("path"), rule.alias("rule"))
    fields, rules = F.col("_fields"), F.col("_rules")
    unknown = F.transform(F.array_except(F.map_keys(fields), F.transform(rules, lambda r: r["name"])), lambda k: found(k, F.lit("not_allowed")))
    held = F.transform(rules, lambda r: F.struct(r.alias("r"), F.try_element_at(fields, r["name"]).alias("value")))
    wrong = F.transform(F.transform(held, lambda h: _read(h["r"], h["value"])), lambda f: F.struct(f["r"]["name"].alias("name"), _broken(f).alias("rule")))
    wrong = F.transform(F.filter(wrong, lambda e: e["rule"].isNotNull()), lambda e: found(e["name"], e["rule"]))
    no_object = F.array(F.struct(F.col("path").alias("path"), F.lit("not_an_object").alias("rule")))
    errors = F.when(fields.isNull(), no_object).otherwise(F.concat(unknown, wrong))
    return refused.unionByName(x.select(key, F.inline(errors)))


def part_rows(df: DataFrame, key: str, part: str, body: str = "body") -> DataFrame:
    """One list of the submissions as a table: key, pos, and the fields of the part; objects and values of any kind as JSON text.

    part: a list's name, 'warnings' or 'gaps' (column text), or 'entities' (all candidates, with entity_set). Only this part of the
    text is read. Items that are no objects give nulls.
    """
    df = _once(df, key, F.try_parse_json(body).alias("_v"))
    of = lambda p: F.coalesce(F.try_variant_get("_v", f"$.{p}", "array<variant>"), F.array().cast("array<variant>"))
    if part == "entities":
        one = lambda s: F.transform(of(f"entities.{s}"), lambda x, i: F.struct(F.lit(s).alias("entity_set"), i.alias("pos"), x.alias("_item")))
        items = df.select(F.col(key), F.inline(F.concat(*map(one, OBJECTS["entities"]))))
    else:
        items = df.select(F.col(key), F.posexplode(of(part)).alias("pos", "_item"))
    if part in ("warnings", "gaps"):
        return items.select(key, "pos", F.try_variant_get("_item", "$", "string").alias("text"))
    fields = CANDIDATE if part == "entities" else LISTS[part]
    return items.select(*items.columns[:-1], *(F.try_variant_get("_item", f"$.{n}", TYPES.get(r[0], "string")).alias(n) for n, r in fields.items()))


def item_rows(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, part, pos, item) of every list, set of candidates, warning and gap: each text is read once for all of them."""
    v = _once(df, key, F.try_parse_json(body).alias("_v"))

    def items(part: str, path: str) -> Column:
        held = F.coalesce(F.try_variant_get("_v", f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(held, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("pos"), x.alias("item")))

    return v.select(key, F.inline(F.concat(*(items(p, p) for p in (*LISTS, "warnings", "gaps")), *(items(p, f"entities.{p}") for p in OBJECTS["entities"]))))


def submission_tables(df: DataFrame, key: str, body: str = "body") -> dict[str, DataFrame]:
    """All tables of the submissions by part; each is a plan of its own that reads its part alone."""
    return {p: part_rows(df, key, p, body) for p in (*LISTS, "entities", "warnings", "gaps")}


def reference_violations(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, path, rule): names of evidence and candidates that the submission itself doesn't hold; key is unique.

    unknown_evidence for the evidence_keys of candidates, claims and relationships; unknown_candidate for subjects and objects.
    Parts of a wrong form have no references. Names used and names held are compared as sets within the submission's own row; only
    those of submissions with an unknown name become rows, and references meet the unknown names in a semi-join.
    """
    v = _once(df, key, F.try_parse_json(body).alias("_v"))
    sets = [f"entities.{s}" for s in OBJECTS["entities"]]
    lists = {p: _items(p, "candidate_key:string,evidence_keys:array<string>") for p in sets}
    lists |= {"claims": _items("claims", "subject_candidate_key:string,evidence_keys:array<string>"), "relationships": _items("relationships", "subject_candidate_key:string,object_candidate_key:string,evidence_keys:array<string>")}
    lists |= {"evidence": _items("evidence", "evidence_key:string")}
    v = _once(v, key, *(items.alias(p) for p, items in lists.items()))
    ref = lambda path, name, rule: F.struct(path.alias("path"), name.alias("name"), F.lit(rule).alias("rule"))
    held_as = lambda name, rule: F.struct(name.alias("name"), F.lit(rule).alias("rule"))

    def used(part: str, *fields: str) -> Column:
        def of(x, i):
            at = F.concat(F.lit(f"{part}["), i.cast("string"), F.lit("]."))
            keys = F.transform(F.coalesce(x["evidence_keys"], F.array().cast("array<string>")), lambda k, j: ref(F.concat(at, F.lit("evidence_keys["), j.cast("string"), F.lit("]")), k, "unknown_evidence"))
            return F.concat(keys, *(F.array(ref(F.concat(at, F.lit(f)), x[f], "unknown_candidate")) for f in fields))

        return F.flatten(F.transform(f"`{part}`", of))

    uses = F.concat(*map(used, sets), used("claims", "subject_candidate_key"), used("relationships", "subject_candidate_key", "object_candidate_key"))
    held = F.concat(F.transform("evidence", lambda x: held_as(x["evidence_key"], "unknown_evidence")), *(F.transform(f"`{s}`", lambda x: held_as(x["candidate_key"], "unknown_candidate")) for s in sets))
    rows = _once(v, key, F.filter(uses, lambda r: r["name"].isNotNull()).alias("_uses"), held.alias("_held"))
    unknown = F.array_except(F.transform("_uses", lambda r: F.struct(r["name"].alias("name"), r["rule"].alias("rule"))), "_held")
    # Written, so that both sides of the join below don't read all texts again.
    rows = written(_once(rows, key, F.col("_uses"), unknown.alias("_unknown")).where(F.size("_unknown") > 0), "references")
    return rows.select(key, F.inline("_uses")).join(rows.select(key, F.inline("_unknown")), [key, "name", "rule"], "left_semi").select(key, "path", "rule")


def outcomes(df: DataFrame, key: str, version: str, body: str = "body") -> DataFrame:
    """(key, outcome, n_violations, partial, needs_identity) for each submission; key is unique.

    outcome: unsupported_contract; rejected, if it has violations of shape or, having none, of references; else accepted. partial:
    an evidence without its content, or a gap. needs_identity: a candidate that asks for a resolution. Both are false where refused.
    The counts meet the submissions by key alone.
    """
    shape = shape_violations(df, key, version, body).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("rule") == "unsupported_contract").alias("_other"))
    refs = reference_violations(df, key, body).groupBy(key).agg(F.count(F.lit(1)).alias("_refs"))
    v = _once(df, key, F.try_parse_json(body).alias("_v"))
    gaps = F.coalesce(F.size(F.try_variant_get("_v", "$.gaps", "array<string>")) > 0, F.lit(False))
    partial = F.exists(_items("evidence", "content_base64:string"), lambda e: e["content_base64"].isNull()) | gaps
    asks = lambda s: F.exists(_items(f"entities.{s}", "identity_resolution_required:boolean"), lambda c: F.coalesce(c["identity_resolution_required"], F.lit(False)))
    needs = reduce(lambda a, b: a | b, map(asks, OBJECTS["entities"]))
    out = v.select(key, partial.alias("_partial"), needs.alias("_needs")).join(shape, key, "left").join(refs, key, "left")
    n = F.coalesce("_n", "_refs", F.lit(0))
    outcome = F.when(F.col("_other"), "unsupported_contract").when(n == 0, "accepted").otherwise("rejected")
    return out.select(key, outcome.alias("outcome"), n.alias("n_violations"), ((n == 0) & F.col("_partial")).alias("partial"), ((n == 0) & F.col("_needs")).alias("needs_identity"))
