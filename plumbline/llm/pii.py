"""Operator 2, personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

``find_pii`` adds an array ``pii`` of structs (start, rank, end, kind, score) over the whole text: code points, end
exclusive, ordered by start, then kind. Base kinds (email, ip, card, phone) are leftmost non-overlapping matches per
kind; what fails its check is dropped without a retry. Their score only reports confidence, base spans always stay. The
method adds four kinds: ``iban`` (mod 97 confirms), ``card13`` (a 13-digit number that passes Luhn), ``localphone`` (a
national number such as 555-123-4567, which no checksum can confirm) and ``secret`` (a key or token: one run of 20 or more
letters, digits, ``_`` and ``-`` with letters and digits in it whose characters have at least ``MIN_ENTROPY`` bits of
entropy, as random ones do and words do not); an added span has to reach ``THRESHOLD`` and
must not overlap a base span. Of overlapping added spans of different kinds all stay. Score = base score of the kind + 0.3 for a context word within 40 characters before or 20
after.

Only built-in functions are used. The patterns equal the plain ones but are possessive and start only where a run
starts, so that long runs cost linear time and no stack.

Defined cases: null and empty texts have no spans; repeated rows each get their own; an empty table gives an empty
table; extra columns are kept (``pii`` is
overwritten).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read

KINDS = ("email", "ip", "card", "phone", "iban", "card13", "localphone", "secret")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.6
MIN_ENTROPY = 2.8

#: Pattern, score without context, context words.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SECRET = r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])"
SCORES = {"secret": 0.4, "email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "card13": 0.4, "localphone": 0.4}
CONTEXT = {
    "email": "e-?mail|contact|mailto|write|courriel|correo",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|credit|debit|payment|carte|karte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "card13": "card|visa|credit|debit|payment|carte|karte|tarjeta",
    "secret": r"token|secret|passw|pwd\b|api|\bkey\b|_key|auth|bearer|credential|clé|clave|schlüssel|kennwort",
    "localphone": r"phone|call|tel\b|mobile|fax|telefon|téléphone|teléfono",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Matches are walked in chunks of this many, so that appending costs no square of their number.
_CHUNK = 64
#: Characters of context on either side of a match.
BEFORE, AFTER = 40, 20

_SPAN = "struct<start: int, rank: int, end: int, kind: string, score: double>"


def _mod97(iban: Column) -> Column:
    s = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, low: int, high: int) -> Column:
    d = _digits(value)
    return F.length(d).between(low, high) & F.call_function("luhn_check", d)


def _entropy(value: Column) -> Column:
    """Bits of Shannon entropy of the characters of a value."""
    chars = F.split(value, "")
    n = F.length(value)

    def share(ch: Column) -> Column:
        p = (n - F.length(F.replace(value, ch, F.lit("")))) / n
        return -p * F.log2(p)

    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc + share(ch))


CHECKS = {
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (_entropy(v) >= MIN_ENTROPY),
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"),
    "card": lambda v: _card(v, 14, 19),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "iban": lambda v: F.length(F.regexp_replace(v, " ", "")).between(15, 34) & (_mod97(v) == 1),
    "card13": lambda v: _card(v, 13, 13),
    "localphone": lambda v: F.lit(True),
}


def _near(found: Column, gaps: Column, i: Column) -> Column:
    """The BEFORE characters of the text before match i and the AFTER characters behind it, other matches included. A match has two characters at least, so few of them reach in, and its cost doesn't grow with the text."""
    text = F.transform(F.sequence(F.greatest(i - BEFORE // 2, F.lit(0)), i), lambda j: F.concat(F.right(F.get(gaps, j), F.lit(BEFORE)), F.when(j < i, F.right(F.get(found, j), F.lit(BEFORE))).otherwise("")))
    behind = F.transform(F.sequence(i + 1, F.least(i + 1 + AFTER // 2, F.size(found))), lambda j: F.concat(F.substring(F.get(gaps, j), 1, AFTER), F.coalesce(F.substring(F.get(found, j), 1, AFTER), F.lit(""))))
    return F.concat_ws(" ", F.right(F.array_join(text, ""), F.lit(BEFORE)), F.substring(F.array_join(behind, ""), 1, AFTER))


def _spans(text: Column, pattern: str, kinds: tuple[str, ...]) -> Column:
    """All matches of a pattern that one of ``kinds`` confirms, as an array of _SPAN."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def walk(acc: Column, i: Column, found: Column, gaps: Column) -> Column:
        value, before, after = F.get(found, i), F.get(gaps, i), F.get(gaps, i + 1)
        start = acc["at"] + F.length(before)
        end = start + F.length(value)
        near = _near(found, gaps, i)
        label, score, rank = F.lit(None).cast("string"), F.lit(0.0), F.lit(0)
        for k in kinds:
            ok = CHECKS[k](value)
            label = F.when(ok, k).otherwise(label)
            score = F.when(ok, F.lit(SCORES[k]) + F.when(near.rlike("(?i)" + CONTEXT[k]), 0.3).otherwise(0.0)).otherwise(score)
            rank = F.when(ok, KINDS.index(k)).otherwise(rank)
        one = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), label.alias("kind"), score.alias("score"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    empty = F.array().cast(f"array<{_SPAN}>")

    def all_of(m: Column) -> Column:
        parts = m["gaps"], m["found"]
        n = F.size(m["found"])

        def chunk(acc: Column, c: Column) -> Column:
            inner = F.aggregate(F.sequence(c * _CHUNK, F.least(c * _CHUNK + _CHUNK, n) - 1), F.struct(acc["at"].alias("at"), empty.alias("spans")), lambda a, i: walk(a, i, parts[1], parts[0]))
            return F.struct(inner["at"].alias("at"), F.concat(acc["spans"], F.array(inner["spans"])).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("spans"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), start, chunk)["spans"])

    # a one-element array names the match lists once for everything that uses them
    once = F.transform(F.array(F.struct(found.alias("found"), F.when(F.size(found) > 0, gaps).alias("gaps"))), lambda m: F.when(F.size(m["found"]) > 0, F.filter(all_of(m), lambda s: s["kind"].isNotNull())).otherwise(empty))
    return F.flatten(once)


def find_pii(df: DataFrame, text: str = "text", added: bool = True) -> DataFrame:
    """``df`` with the column ``pii``; ``added`` turns the kinds of the method on."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [_spans(t, EMAIL, ("email",)), _spans(t, IP, ("ip",)), _spans(t, DIGITS, ("card", "card13") if added else ("card",)), _spans(t, PHONE, ("phone",))]
    if added:
        parts += [_spans(t, IBAN, ("iban",)), _spans(t, LOCAL, ("localphone",)), _spans(t, SECRET, ("secret",))]
    every = "_all"
    while every in df.columns:
        every += "_"
    found = df.withColumn(every, F.concat(*parts))
    base = F.filter(every, lambda s: s["rank"] < len(BASE_KINDS))
    more = F.filter(every, lambda s: (s["rank"] >= len(BASE_KINDS)) & (s["score"] >= THRESHOLD))
    clear = F.filter(more, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.withColumn("pii", F.when(F.size(every) > 0, F.array_sort(F.concat(base, clear))).otherwise(F.col(every))).drop(every)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[: len(BASE_KINDS)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), *counts[len(BASE_KINDS) :])
