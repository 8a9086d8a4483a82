"""Predicates, classifiers and scores over drawing text and fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansift.functions.text import halved

# Drawing words, pipe diameters, tolerances and score points that results depend on.
HINT = r"(?iu)\[\[(?:\w+_)?DRAWING:(PZT|PROFIL)\]\]"
PROFILE_WORDS = r"(?ius)RZĘDNE\s+DNA\s+PRZEWODU|ZAGŁ[EĘ]BIENIE\s+DNA|PROFILE?\s+PODŁU|\bPROFIL\b.{0,80}KANALIZACJI|KANALIZACJI.{0,80}\bPROFIL\b"
PLAN_WORDS = r"(?iu)PLAN\s+SYTUACYJNO|PROJEKT\s+ZAGOSPODAROWANIA\s+TERENU|\bPZT\b|\bPYT\b"
INLET_TABLE_WORDS = (r"(?iu)RZĘDNA\s+DNA\s+STUDZIENKI", r"(?iu)RZĘDNA\s+WLOTU", r"(?iu)DŁUGOŚĆ\s+PRZYKANALIKÓW")
ENGINEERING = r"(?iu)\b(?:KD|KS|WP|K)\s*\d{1,3}(?:[./-]\d+)*\b|\b(?:DN|Ø)\s*\d{2,4}\b|\b(?:PE-HD|PEHD|HDPE|PVC|PP|PE)\b"
CANDIDATE = r"(?iu)\b(?:KD|KS|WP|D)\s*\d{1,3}(?:[./-]\d+)*\b|\bSO\b|\b(?:DN|Ø)\s*\d{2,4}\b"
PIPE_DIAMETERS = (50, 63, 75, 90, 100, 110, 125, 150, 160, 200, 225, 250, 300, 315, 400, 450, 500, 600, 630, 800)
PREFERRED_DIAMETERS = (1000, 1200, 1500, 2000, 2500, 3000, 800)
FIELDS = ("oznaczenie", "DN studni", "rzędna góry", "rzędna dna", "wysokość", "typ", "zwieńczenie", "przejścia szczelne")


def filled(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def drawing_type(text: Column) -> Column:
    """PZT, PROFIL, TABELA WPUSTÓW or NIEZNANY, from all of a document's text: a hint first, then the words."""
    table = text.rlike(INLET_TABLE_WORDS[0]) & text.rlike(INLET_TABLE_WORDS[1]) & text.rlike(INLET_TABLE_WORDS[2])
    return (
        F.when(text.rlike(HINT), F.upper(F.regexp_extract(text, HINT, 1)))
        .when(text.rlike(PROFILE_WORDS), "PROFIL")
        .when(text.rlike(PLAN_WORDS), "PZT")
        .when(table, "TABELA WPUSTÓW")
        .otherwise("NIEZNANY")
    )


def drawing_type_of_name(name: Column) -> Column:
    """PZT or PROFIL from a file's name, else null; plan words come first."""
    plain = F.upper(F.regexp_replace(F.element_at(F.split(name, r"[/\\\\]"), -1), r"\.[^.]*$", ""))
    return F.when(plain.rlike("PZT|ZAGOSPODAROWANIA TERENU|PLAN SYTUACYJ"), "PZT").when(plain.rlike("PROFIL|PODŁUŻ|PODLUZ"), "PROFIL")


def useful_page(text: Column, n_items: Column) -> Column:
    return F.coalesce(text.rlike(CANDIDATE) | (F.length(F.trim(text)) >= 20), F.lit(False)) | (n_items >= 3)


def primary_text(raw: Column, ordered: Column) -> Column:
    """The stream with more candidates; at a tie the ordered one if it has 35 % of the raw one's length; a blank one never."""
    a, b = F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(CANDIDATE)), F.regexp_count(F.coalesce(ordered, F.lit("")), F.lit(CANDIDATE))
    long_enough = F.length(F.coalesce(ordered, F.lit(""))) >= 0.35 * F.length(F.coalesce(raw, F.lit("")))
    some = F.when(b > a, ordered).when((a == b) & long_enough, ordered).otherwise(raw)
    return F.when(~filled(raw), F.coalesce(ordered, F.lit(""))).when(~filled(ordered), raw).otherwise(some)


def likely_identifier(identifier: Column) -> Column:
    """KDIST, SO, or letters and a number below 100 with at most two short indices below 20."""
    plain = F.upper(identifier)
    main = F.regexp_extract(plain, r"^(?:KD|KS|D|S|K)(\d+)", 1)
    tail = F.regexp_extract(plain, r"^(?:KD|KS|D|S|K)\d+(.*)$", 1)
    short = F.forall(F.regexp_extract_all(tail, F.lit(r"[./-](\d{1,2})"), F.lit(1)), lambda n: n.cast("int") < 20)
    number = F.coalesce(main.try_cast("int") < 100, F.lit(False))
    fine = number & ((tail == "") | (tail.rlike(r"^(?:[./-]\d{1,2}){1,2}$") & short))
    return plain.isin("KDIST", "SO") | F.coalesce(fine, F.lit(False))


def elevation(token: Column) -> Column:
    """Metres from 20 to 300 with two decimals, after the usual misreadings are put right; else null."""
    t = F.translate(F.trim(halved(token)), "]|Il,", "1111.")
    t = F.regexp_replace(t, r"^[^0-9]+|[^0-9.]+$", "")
    value = F.when(t.rlike(r"^\d{2,3}\.\d{2}$"), t.try_cast("double"))
    return F.when(value.between(20, 300), value)


def number_or_zero(token: Column) -> Column:
    return F.coalesce(F.replace(token, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def plausible_manhole_diameter(mm: Column) -> Column:
    return mm.between(800, 4000) & (mm % 50 == 0)


def keeps_ocr_pipe(material: Column, mm: Column, in_repeated_row: Column) -> Column:
    """Whether a pipe read by OCR from a profile stays."""
    known = filled(material) & mm.isNotNull()
    return F.coalesce(known & (mm.isin(*PIPE_DIAMETERS) | ((mm >= 150) & (mm < 800)) | ((mm >= 800) & ~in_repeated_row)), F.lit(False))


def cents(value: Column) -> Column:
    """Two decimals, half to even, by scaling first."""
    return F.rint(value * 100) / 100


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def snapped(value: Column, step: float) -> Column:
    return F.rint(value / step) * step


def height_of_depth(depth: Column) -> Column:
    return F.when(depth.between(0.5, 10), F.greatest(F.lit(0.2), depth - 0.15))


def confidence_points(diameter, ground, invert, height, type_, crown, n_transitions) -> Column:
    p = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    full = ground.isNotNull() & invert.isNotNull() & height.isNotNull()
    return p(diameter.isNotNull(), 2) + F.when(full, 3).when(height.isNotNull(), 1).otherwise(0) + p(filled(type_), 2) + p(filled(crown), 1) + p(F.coalesce(n_transitions, F.lit(0)) > 0, 2)


def confidence(points: Column) -> Column:
    return F.when(points >= 5, "wysoka").when(points >= 2, "średnia").otherwise("niska")


def confidence_rank(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low == "wysoka", 3).when(low.isin("średnia", "srednia"), 2).otherwise(1)


def present(identifier, diameter, ground, invert, height, type_, crown, n_transitions) -> list[Column]:
    """Which of FIELDS a record has, in their order."""
    return [filled(identifier), diameter.isNotNull(), ground.isNotNull(), invert.isNotNull(), height.isNotNull(), filled(type_), filled(crown), F.coalesce(n_transitions, F.lit(0)) > 0]


def completeness(flags: list[Column]) -> Column:
    """The share of fields in percent, half to even."""
    n = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    return F.rint(n * 100.0 / len(flags)).cast("int")


def missing(flags: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(~f, F.lit(name)) for f, name in zip(flags, FIELDS, strict=True)]), lambda x: x.isNotNull()), ", ")


def upgraded(conf: Column, n_sources: Column, percent: Column, issues: Column) -> Column:
    """wysoka for a complete record without issues that two sources bear out."""
    return F.when((n_sources >= 2) & (percent >= 70) & ~filled(issues), F.lit("wysoka")).otherwise(conf)


def credible_anchor(identifier: Column, score: Column) -> Column:
    """Whether a label that OCR read from a plan has enough evidence round it: D and S with a number least, then others, more with an
    index, from 30 on and for SO."""
    number = F.regexp_extract(identifier, r"^[DS](\d+)$", 1).try_cast("int")
    needed = F.when(number >= 30, 4).when(number.isNotNull(), 1).when(identifier.rlike(r"^[DS]\d+[./-]\d+$"), 3).when(identifier == "SO", 4).otherwise(2)
    return score >= needed


def weak_candidate(is_ocr: Column, score: Column, ground: Column, diameter: Column, n_transitions: Column) -> Column:
    return is_ocr & (score <= 1) & ground.isNull() & diameter.isNull() & (n_transitions == 0)


def unsupported_ocr(identifier: Column, is_ocr: Column, has_evidence: Column) -> Column:
    n = F.regexp_extract(F.upper(F.coalesce(identifier, F.lit(""))), r"^(?:D|S)(\d+)$", 1).try_cast("int")
    return is_ocr & F.coalesce(n >= 80, F.lit(False)) & ~has_evidence


def equivalent_type(actual: Column, expected: Column) -> Column:
    """Of folded texts: one within the other (the actual one at least four letters if it is the inner)."""
    return F.contains(actual, expected) | (F.contains(expected, actual) & (F.length(actual) >= 4))


def equivalent_crown(actual: Column, expected: Column) -> Column:
    ring = F.contains(expected, F.lit("pierscien")) & F.contains(expected, F.lit("plyta"))
    return (
        F.when(actual == "", False)
        .when(F.contains(expected, F.lit("zwezka")), F.contains(actual, F.lit("zwezka")))
        .when(ring, F.contains(actual, F.lit("pierscien")) & F.contains(actual, F.lit("plyta")))
        .otherwise(F.contains(actual, expected) | F.contains(expected, actual))
    )
