"""Roster extraction from stored pages: anchors, tables, cards, headed lists, label pairs. All of it is columns of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspine import functions as fn
from recordspine.operators.relational import top_k, under_marker


def table_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, row, cells): the text of each cell of each table row, in order."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "body"))
    cells = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), fn.html_text)
    return rows.select(key, "row", cells.alias("cells"))


def anchors(pages: DataFrame, key: str, html: str, path: str) -> DataFrame:
    """(key, pos, href, name, context): anchors whose href matches path, with the text up to the next such anchor."""
    split = F.split(F.concat(F.lit(" "), F.col(html)), rf'(?=<a [^>]*href="{path})')  # a page may begin with an anchor
    parts = pages.select(key, F.posexplode(split).alias("pos", "part")).where("pos > 0")
    href = F.regexp_extract("part", r'<a [^>]*href="([^"]*)"', 1)
    name = fn.html_text(F.regexp_extract("part", r"(?is)<a [^>]*>(.*?)</a>", 1))
    return parts.select(key, "pos", href.alias("href"), name.alias("name"), fn.html_text(F.regexp_replace("part", r"(?is)^<a .*?</a>", "")).alias("context"))


def directory_members(pages: DataFrame, key: str, html: str, path: str) -> DataFrame:
    """Anchors with the district and party that their context names; vacancies are told apart."""
    a = anchors(pages, key, html, path)
    district = F.regexp_extract("context", r"(?i)district:?\s*(\d+)", 1)
    party = F.regexp_extract("context", r"(?i)\b(Republican|Democrat(?:ic)?|Independent)\b", 1)
    return a.select(key, "href", "name", F.nullif(district, F.lit("")).cast("int").alias("district"), fn.party(party).alias("party"), F.lower("name").startswith("vacan").alias("vacant"))


def single_card(pages: DataFrame, key: str, html: str, office: str) -> DataFrame:
    """The one person linked in the one card that names the office; pages with none or several give no row."""
    cards = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<div class="card[^"]*">(.*?)</div>'), F.lit(1))).alias("card")).where(F.lower("card").contains(office.lower()))
    people = cards.select(key, F.explode(F.array_distinct(F.regexp_extract_all("card", F.lit(r'(?is)<a [^>]*href="([^"]*)"'), F.lit(1)))).alias("href"), "card")
    one = people.groupBy(key).agg(F.count_distinct("card").alias("cards"), F.count_distinct("href").alias("links"), F.first("href").alias("href"))
    return one.where("cards = 1 AND links = 1").select(key, "href")


def profile_name(html: Column) -> Column:
    """The first of og:title, twitter:title, h1 and title that is a name, up to a bar or dash, or that says that the seat is
    vacant ('Vacant'); null if none is."""

    def meta(name: str) -> Column:
        named, held = rf"""(?:property|name)=["']{name}["']""", r"""content=(?:"([^"]*)"|'([^']*)')"""
        both = [F.concat(F.regexp_extract(html, p, 1), F.regexp_extract(html, p, 2)) for p in (rf"(?is)<meta\s[^>]*?{named}[^>]*?{held}", rf"(?is)<meta\s[^>]*?{held}[^>]*?{named}")]
        return F.coalesce(F.nullif(both[0], F.lit("")), both[1])

    found = F.transform(F.array(meta("og:title"), meta("twitter:title"), F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), fn.html_text)
    name = lambda x: F.trim(F.regexp_replace(x, r"\s*[|—-].*$", ""))
    read = F.transform(found, lambda x: F.when(x.rlike(r"(?i)\bvacant\b"), "Vacant").when(fn.looks_like_person_name(name(x)), name(x)))
    return F.get(F.filter(read, lambda x: x.isNotNull()), F.lit(0))


def section_items(lines: DataFrame, doc: str, pos: str, text: str, heading: Column) -> DataFrame:
    """Lines with the heading that they stand under; headings themselves are left out."""
    return under_marker(lines, doc, pos, heading).where(heading.isNull() & F.col("section").isNotNull()).select(doc, pos, "section", text)


def roster_lines(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", text: str = "line") -> DataFrame:
    """Office, holder and term of rosters printed as text: an office line, then a name line, a term in brackets."""
    office = F.when(F.col(text).rlike(r"(?i)^(mayor|commissioner|clerk|sheriff|judge|property appraiser|tax collector)\b"), F.trim(text))
    rows = under_marker(lines, doc, pos, office)
    term = F.regexp_extract(text, r"(?i)\(?(?:term|expires):?\s*(\d{4})\)?", 1)
    name = F.trim(F.regexp_replace(text, r"(?i)\s*\(?(?:term|expires):?.*$", ""))
    return rows.where(office.isNull() & F.col("section").isNotNull() & fn.looks_like_person_name(name)).select(doc, pos, F.col("section").alias("office"), name.alias("name"), F.nullif(term, F.lit("")).cast("int").alias("term_end"))


def label_values(lines: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, label, value) of lines like 'Label: value'."""
    m = lambda i: F.regexp_extract(text, r"^\s*([A-Z][A-Za-z /]{1,40}):\s*(\S.*)$", i)
    return lines.select(doc, fn.slug(m(1), "underscore").alias("label"), F.trim(m(2)).alias("value")).where("label <> ''")


def image_scores(images: DataFrame, page: str, url: str, method: Column, preferred: Column, excluded: Column, name_tokens: Column, k: int = 6) -> DataFrame:
    """The k best pictures of a page: method's base, +9 preferred word, -35 excluded word, +12 a token of the name, +4 a picture's ending; ties by url."""
    base = F.when(method == "og:image", 40).when(method == "twitter:image", 35).otherwise(20)
    score = base + F.when(preferred, 9).otherwise(0) - F.when(excluded, 35).otherwise(0)
    score = score + F.aggregate(name_tokens, F.lit(0), lambda s, w: s + F.when(F.contains(F.lower(F.col(url)), w), 12).otherwise(0)) + F.when(F.lower(url).rlike(r"\.(jpe?g|png|webp)$"), 4).otherwise(0)
    return top_k(images.withColumn("score", score), [page], [F.col("score").desc(), F.col(url)], k)


def next_context(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Each line with the one behind it."""
    return lines.withColumn("behind", F.lead(text).over(Window.partitionBy(doc).orderBy(pos)))


def combined_lines(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Office, district and holder of rows that hold all of it: 'Commissioner, District 4 - Jane Doe', 'Mayor: Jane Doe', 'Sheriff | Jane Doe'."""
    m = lambda i: F.trim(F.regexp_extract(text, r"^\s*(\p{L}[\p{L} ]*?)(?:,?\s+District\s+(\d+))?\s*(?:\s[-–—]\s|:|\|)\s*(\S.*)$", i))
    rows = lines.select(doc, pos, m(1).alias("office"), F.nullif(m(2), F.lit("")).cast("int").alias("district"), m(3).alias("name"))
    return rows.where((F.col("office") != "") & fn.looks_like_person_name(F.col("name")))


def education_entries(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, pos, entry, review_status): parts of an education text between semicolons and line ends; each waits for a review."""
    parts = F.filter(F.transform(F.split(raw, r"\s*;\s*|\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return df.select(key, F.posexplode(parts).alias("pos", "entry")).withColumn("review_status", F.lit("unreviewed"))


def office_blocks(pages: DataFrame, key: str, html: str, terms: tuple[str, ...] = ("office", "address")) -> DataFrame:
    """(key, pos, label, line, n): texts of paragraphs and list items below headings that name one of the terms, up to the next heading."""
    parts = pages.select(key, F.posexplode(F.split(html, r"(?i)(?=<h[1-6][\s>])")).alias("pos", "part"))
    label = fn.html_text(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    named = parts.select(key, "pos", "part", label.alias("label")).where(F.lower("label").rlike("|".join(terms)))
    items = F.transform(F.regexp_extract_all("part", F.lit(r"(?is)<(?:p|li|address|dd)(?:\s[^>]*)?>(.*?)</(?:p|li|address|dd)>"), F.lit(1)), fn.html_text)
    return named.select(key, "pos", "label", F.posexplode(F.slice(F.array_distinct(F.filter(items, lambda x: x != "")), 1, 30)).alias("n", "line"))


def named_links(pages: DataFrame, key: str, html: str, base: str, terms: tuple[str, ...], most: int = 50) -> DataFrame:
    """(key, label, url): web addresses of anchors whose text or href names one of the terms, each once, the first ones of a page."""
    a = pages.select(key, base, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))).alias("pos", "a"))
    href, label = F.regexp_extract("a", 'href="([^"]*)"', 1), fn.html_text(F.col("a"))
    a = a.select(key, "pos", label.alias("label"), fn.canonical_url(href, F.col(base)).alias("url"), F.lower(F.concat_ws(" ", label, href)).alias("said"))
    a = a.where(F.col("url").isNotNull() & F.col("said").rlike("|".join(terms))).groupBy(key, "url").agg(F.min(F.struct("pos", "label")).alias("first"))
    a = a.select(key, "url", F.col("first.pos").alias("pos"), F.coalesce(F.nullif("first.label", F.lit("")), "url").alias("label"))
    return top_k(a, [key], [F.col("pos")], most).select(key, "label", "url")


def state_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, state, row, cells): rows of member tables under each table's caption, header rows left out."""
    t = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "body"))
    state = fn.html_text(F.regexp_extract("body", r"(?is)<caption[^>]*>(.*?)</caption>", 1))
    t = t.select(key, "table", state.alias("state"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), fn.html_text)
    return t.select(key, "table", "state", "row", cells.alias("cells")).where((F.size("cells") > 0) & (F.col("state") != ""))
