"""Personal data: patterns propose, checksums confirm, context words adjust the score.

Built-in SQL functions only.  Positions come from splitting a text at a
pattern's matches: the pieces between and the matches, laid end to end, give
code-point offsets.  Patterns use possessive repeats and look-behinds that
start a match at the left end of a run only, so time is linear in the text
and the matcher's stack does not grow with it.

Base kinds (email, ip, card, phone) are kept whenever their rule holds.  The
method adds IBANs, whose remainder modulo 97 must be 1, and national numbers
written 123-45-6789, which need a context word.  Context is the NEAR characters
before a span, whatever stands there; members of a list share the first one's.
An IBAN has its country's length; one of an unlisted country is as long as it
can be.  Null and empty texts have no spans; rows are independent, so repeated
rows and ids repeat results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "national"]
BASE = 4

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(IBAN_LENGTHS.values()).split())
_LONG = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()]
_IBAN = "|".join([*_LONG, rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"])

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # reads ahead and passes over the first four characters only, so a false start hides no IBAN behind it
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_IBAN})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that make a kind likelier when they stand just before a span.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": "card|visa|credit|karte|tarjeta|carte",
    "phone": r"phone|\btel\b|call|mobile|telefon|tel[eé]fono",
    "iban": "iban|account|konto|cuenta|compte|bank",
    "national": r"\bssn\b|social|security|national|tax",
}
#: Score of a confirmed span, and what a context word adds.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national": 0.3}
BONUS, LEAST, NEAR = 0.2, 0.5, 48
#: What stands between members of a list: punctuation, white space and one short word.
_BETWEEN = r"^[^\p{L}\p{N}.]{1,8}(?:\p{L}{1,3}[^\p{L}\p{N}.]{1,4})?$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c <= "9", F.lit(10)).otherwise(F.lit(100)) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = _digits(m)
        return (F.length(d) <= 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m) == 1
    return F.lit(True)


_SPAN = "struct<start:int,kind_no:int,stop:int,kind:string,score:double>"


def spans(text: Column, kind: str) -> Column:
    """array<struct<start, kind_no, stop, kind, score>> of one kind's confirmed spans."""
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(1 if kind == "iban" else 0))
    gaps = F.split(text, PATTERNS[kind], -1)

    def measure(gap: Column, match: Column) -> Column:
        ok = F.coalesce(match.isNotNull() & _confirmed(kind, match), F.lit(False))
        passed = F.coalesce(F.substring(match, 1, 4) if kind == "iban" else match, F.lit(""))
        end = F.coalesce(F.substring(gap, -NEAR, NEAR), F.lit(""))
        listed = F.coalesce(gap.rlike(_BETWEEN), F.lit(False))
        return F.struct(F.coalesce(F.length(gap), F.lit(0)).alias("g"), F.coalesce(F.length(match), F.lit(0)).alias("m"), ok.alias("ok"), passed.alias("passed"), end.alias("end"), listed.alias("listed"))

    # the text just before, and whether the last match had context
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit("").alias("tail"), F.lit(False).alias("near"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + x["g"]
        before = F.substring(F.concat(acc["tail"], x["end"]), -NEAR, NEAR)
        near = F.lower(before).rlike(CONTEXT[kind]) | acc["near"] & x["listed"]
        score = F.lit(SCORE[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (at + x["m"]).alias("stop"), F.lit(kind).alias("kind"), score.alias("score"))
        out = F.when(x["ok"] & (score >= LEAST), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        tail = F.substring(F.concat(before, x["passed"]), -NEAR, NEAR)
        return F.struct((at + F.length(x["passed"])).alias("pos"), out.alias("out"), tail.alias("tail"), near.alias("near"))

    found = F.aggregate(F.zip_with(gaps, matches, measure), start, step, lambda acc: acc["out"])
    empty = F.array().cast(f"array<{_SPAN}>")
    # most texts have no such span: a cheap test saves the split
    return F.when(text.rlike(PATTERNS[kind]), found).otherwise(empty)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` plus ``out``: every span, by start and then kind.

    A column that is already called ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*(spans(text, k) for k in KINDS))))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans, top_score) for each row."""
    found = find_pii(docs.select("doc_id", "text"), out="__pii").select(F.col("doc_id").cast("bigint").alias("doc_id"), "__pii")
    base = F.filter("__pii", lambda s: s["kind_no"] < BASE)
    count = lambda k: F.size(F.filter("__pii", lambda s: s["kind_no"] == k))
    counts = [count(k).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    top = F.array_max(F.transform("__pii", lambda s: s["score"])).alias("top_score")
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("__pii")).alias("spans"), top)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets.

    Spans that overlap the one before are merged into it.  Null texts stay null.
    """
    found = find_pii(docs, text_col, "__pii")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), out.alias("out"))

    clean = F.aggregate("__pii", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("__pii") > 0, clean).otherwise(text)).drop("__pii")
