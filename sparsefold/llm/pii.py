"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``find_pii`` adds an array of spans (kind, start, end in code points, score). Email, ip, card and phone spans always stay
once their checks pass; iban, ssn, short card and local phone spans stay when validator and context lift their score to
the threshold and they overlap none of the former. A null text counts as empty and gives an empty array. Rows are
independent: repeated rows give repeated results, an empty table gives an empty one, and an input column named like the
output is replaced. Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "short_card", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
THRESHOLD = 0.5
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24

#: Score of a confirmed span without any context.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "short_card": 0.4, "local_phone": 0.3}
FOR, AGAINST = 0.25, -0.3
SUPPORT = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "address", "login", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "amex", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "cell"},
    "iban": {"iban", "bank", "account", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security"},
}
SUPPORT |= {"short_card": SUPPORT["card"], "local_phone": SUPPORT["phone"]}
DOUBT = {"version", "isbn", "issn", "order", "invoice", "hash", "example", "sample", "serial", "part", "build", "release"}

LOCAL, HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
MAIL_HERE = re.compile(rf"{LOCAL}++@{HOST}++(?:\.{HOST}++)++")
#: A local part starts where its run of characters starts; trying later starts of one run would be quadratic.
MAIL_RUN = re.compile(rf"(?<!{LOCAL}){MAIL_HERE.pattern}")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Characters of an account number by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BI=27, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DJ=27, DK=18, DO=28,
    EE=20, EG=29, ES=24, FI=18, FK=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27,
    JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MN=20, MR=27, MT=31, MU=30, NI=28, NL=18,
    NO=15, OM=23, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, RU=33, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, SO=23, ST=25, SV=28,
    TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20, YE=30)
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2})")
IBAN_OF = {n: re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{n - 1}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
ANY_DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    while m := MAIL_HERE.match(text, at) or MAIL_RUN.search(text, at):
        yield m.span()
        at = m.end()


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in emails(text):
            yield "email", s, e
    if ANY_DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield "ip", *m.span()
        for m in DIGITS.finditer(text):
            if m.end() - m.start() <= 40 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                yield "card", *m.span()
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(digits_of(m.group())) <= 15:
                    yield "phone", *m.span()


def added_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if not ANY_DIGIT.search(text):
        return
    for head in IBAN_HEAD.finditer(text):
        length = IBAN_LENGTHS.get(head.group())
        m = length and IBAN_OF[length].match(text, head.start())
        if m and mod97(m.group().replace(" ", "")):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "ssn", *m.span()
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 30 and 13 <= len(d := digits_of(m.group())) <= 15 and luhn(d):
            yield "short_card", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {*WORD.findall(text[max(0, start - CONTEXT_BEFORE):start].lower()), *WORD.findall(text[end:end + CONTEXT_AFTER].lower())}
    return round(min(1.0, max(0.0, PRIOR[kind] + FOR * bool(near & SUPPORT[kind]) + AGAINST * bool(near & DOUBT))), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[dict]:
    """All spans by kind, then start."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in base_spans(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, reach = [s for s, _ in taken], 0
    ends = [reach := max(reach, e) for _, e in taken]
    for k, s, e in added_spans(text):
        before = bisect_left(starts, e)  # base spans that start before this one ends
        if (not before or ends[before - 1] <= s) and (p := score(text, k, s, e)) >= threshold:
            found.append((k, s, e, p))
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in found]


def pii_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    @F.pandas_udf(SPAN_TYPE)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t or "", threshold) for t in texts], dtype=object)

    return find(text)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    return df.withColumn(out, pii_spans(F.col(text), threshold))


def redact_pii(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first start wins."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts, at = [], 0
            for x in sorted(spans_of(t or "", threshold), key=lambda x: (x["start"], -x["end"])):
                if x["start"] >= at:
                    parts += [t[at:x["start"]], f"<{x['kind']}>"]
                    at = x["end"]
            out.append(None if t is None else "".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return df.withColumn(text, clean(F.col(text)))
