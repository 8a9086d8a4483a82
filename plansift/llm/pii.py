"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score. Built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.spans import after, before, with_matches

#: In the order of kinds at one start. Every repetition is possessive: no backtracking, and no recursion on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed span, and what a context word near it adds. Base kinds stand without context; the others need to reach KEPT.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)mail|contact|kontakt|correo|courriel|@",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|tel|call|mobile|fax|m[oó]vil",
    "iban": r"(?i)iban|account|konto|compte|cuenta|bank",
    "ssn": r"(?i)ssn|social|security|insurance|sozialversicherung",
}
BONUS, KEPT, WINDOW = 0.3, 0.5, 40


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.reverse(number)

    def step(acc: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(turned, i + 1, F.lit(1))) - 48
        return acc + F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """The remainder by 97 of an IBAN's number: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        return ~found.rlike(r"[0-9]{4}") & F.forall(F.split(found, r"\."), lambda p: p.cast("int") <= 255) | found.rlike(r"[0-9]{4}") & F.forall(F.split(found, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(found) == 1
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)") & ~found.rlike("-00-|-0000$")
    return F.lit(True)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans, array<struct<start, kind_no, end, kind, found, score>> by start, then kind, of every row's whole text.

    Leftmost non-overlapping matches of each kind, without retries after a failed check: email, ip (parts at most 255), card (12 to
    19 digits, Luhn), phone (9 to 15 digits), which all stay; iban (mod 97) and ssn, which stay if their score with the words around
    reaches KEPT. Places are code points, end exclusive. A null text counts as empty and has no spans; rows may repeat.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    digit = F.col("_text").rlike("[0-9]")
    needs = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    rows = rows.select("_key", "_text", digit.alias("_digit"))
    rows = with_matches(rows, "_text", {n: (p, needs.get(n, F.col("_digit"))) for n, p in PATTERNS.items()})

    def scored(kind: str, number: int) -> Column:
        fine = F.filter(F.col(kind), lambda s: confirmed(kind, s["found"]))

        def one(s: Column) -> Column:
            near = F.concat_ws(" ", before("_text", s, WINDOW), after("_text", s, WINDOW)).rlike(CONTEXT[kind])
            score = F.lit(SCORE[kind]) + F.when(near, F.lit(BONUS)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), F.lit(number).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found"), F.least(score, F.lit(1.0)).alias("score"))

        out = F.transform(fine, one)
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= KEPT)

    found = [scored(kind, n) for n, kind in enumerate(PATTERNS)]
    return rows.select(F.col("_key").alias(key), F.array_sort(reduce(lambda a, b: F.concat(a, b), found)).alias("spans"))
