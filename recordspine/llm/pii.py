"""Personal data in texts: expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds of the base (kept whatever their score): email, ip (parts at most 255), card (14 to 19 digits, Luhn),
phone (+, 10 to 15 digits). Added kinds, kept from a score of 0.5: iban (mod-97 over the length of its country; of
other codes the longest end from 34 to 15 characters that no capital or digit follows), national_id (grouped or plain
digits that only context words make likely) and secret (a value with a digit behind a name such as password or token and
= or :, and keys of known forms; the name stays, the value is the span). Every expression runs in linear time, also on very long runs of one
character. Null and empty texts have no spans. Rows, order and extra columns pass through untouched; columns of the
same names as the result's are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The expressions of the base kinds (linear forms of those in the contract).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+$")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){1,30}")
IBAN_LENGTHS = {
    c: n for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in codes.split()
}
NATIONAL_ID = re.compile(r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![0-9-])")
SECRET_VALUE = re.compile(r"""[=:]\s{0,3}["']?([A-Za-z0-9_./+-]{8,})""")
SECRET_NAME = re.compile(r"""(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s{0,3}$""")
SECRET_FORM = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "secret")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.2, "secret": 0.7}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "passport", "national", "ausweis", "dni"),
    "secret": ("password", "token", "secret", "key", "login", "credentials"),
}
AGAINST = ("order", "invoice", "version", "isbn", "serial", "example", "test")
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards; the left run is walked back once at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping IBANs; a start that is none hides no later one."""
    done = 0
    for m in IBAN_START.finditer(text):
        if m.start() < done:
            continue
        at = [i for i in range(m.start(), IBAN_REST.match(text, m.end()).end()) if text[i] != " "]
        known = IBAN_LENGTHS.get(m[0][:2])
        for n in (known,) if known else range(len(at), 14, -1):
            end = at[n - 1] + 1 if n <= len(at) else 0
            if end and not re.match("[A-Z0-9]", text[end : end + 1]) and mod97("".join(text[i] for i in at[:n])):
                yield m.start(), end
                done = end
                break


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Keys of known forms and values that a name before them tells to be secret."""
    yield from (m.span() for m in SECRET_FORM.finditer(text))
    for m in SECRET_VALUE.finditer(text):
        if SECRET_NAME.search(text, max(0, m.start() - 20), m.start()) and any("0" <= c <= "9" for c in m[1]):
            yield m.span(1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    around = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    words = set(re.findall(r"[^\W\d_][\w-]*", around))
    s = PRIOR[kind] + 0.35 * any(w in words for w in CONTEXT[kind]) - 0.15 * any(w in words for w in AGAINST)
    return round(min(1.0, max(0.0, s)), 2)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans sorted, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of KINDS; code points, end exclusive."""
    if not text:
        return []
    out = [(*x, score(text, *x)) for x in base_spans(text)]
    taken = merged((s, e) for _, s, e, _ in out)
    extra = [("iban", *x) for x in ibans(text)]
    extra += [("national_id", *m.span()) for m in NATIONAL_ID.finditer(text)]
    extra += [("secret", *x) for x in secrets(text)]
    for kind, s, e in extra:
        p = score(text, kind, s, e)
        at = bisect_left(taken, (e,))  # what begins before the end; disjoint and sorted, so the last of them ends last
        if p >= 0.5 and not (at and taken[at - 1][1] > s):
            out.append((kind, s, e, p))
            taken.insert(at, (s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """Each span (the longest from its start on where they overlap) becomes its kind in angle brackets."""
    if not spans:
        return text
    parts, done = [], 0
    for kind, s, e, _ in spans:
        if s >= done:
            parts += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*parts, text[done:]])


def detect_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_spans (array of kind, start, end, score) and redacted_text (null stays null)."""
    kind = "struct<spans:array<struct<kind:string,start:int,end:int,score:double>>,redacted:string>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.DataFrame:
        spans = [find_spans(t) for t in texts]
        return pd.DataFrame({"spans": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in x] for x in spans], "redacted": [redact(t, x) for t, x in zip(texts, spans, strict=True)]})

    out = docs.withColumn("_pii", found(F.col(text).cast("string")))
    return out.withColumns({"pii_spans": F.col("_pii.spans"), "redacted_text": F.col("_pii.redacted")}).drop("_pii")


def query(spark, sf_dir: str) -> DataFrame:
    from recordspine.llm.common import table

    found = detect_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    spelled = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("pii_spans", lambda x: x["kind"].isin(*BASE_KINDS))
    counted = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(counted, BASE_KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("pii_spans")).alias("spans"))
