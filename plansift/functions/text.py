"""Normalisers of drawing text, as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, materials, words and patterns that results depend on.
LETTERS = "A-Za-zĄąĆćĘęŁłŃńÓóŚśŹźŻżÅÄÖØåäöø"
MATERIALS = "PE-HD|PEHD|HDPE|PVC|PP|PE"
KEYWORDS = "Studnia|Studzienka|Separator|Osadnik|Wp|KD|KS"
ID_NUMBER = r"\d{1,3}(?:[./-]\d+)*"
TYPE_WORDS = {"kinet": "kinetowa", "osadnik": "osadnikowa", "rozpr": "rozprężna", "czyszcz": "czyszczakowa", "tłocz": "tłoczna"}
POLISH, FOLDED = "ąćęłńóśźż", "acelnoszz"


def extracted(text: Column) -> Column:
    """Line feeds to spaces; a space between digits and letters, before materials and keywords; OCR slips of PVC; white space squeezed."""
    t = F.translate(text, "\r\n", "  ")
    t = F.regexp_replace(t, rf"(?<=\d[0-9,.])(?=[{LETTERS}])", " ")
    t = F.regexp_replace(t, rf"(?<=\d)(?=[{LETTERS}])", " ")
    t = F.regexp_replace(t, rf"(?<=[{LETTERS}])(?=\d)", " ")
    t = F.regexp_replace(t, rf"(?iu)(?<!\s)(?=\b(?:{MATERIALS}|{KEYWORDS})\b)", " ")
    t = F.regexp_replace(t, r"(?iu)\bP[¥YV]C(?=\s*\d)", "PVC")
    t = F.regexp_replace(t, r"(?iu)\bPVCI(?=\s*\d)", "PVC")
    t = F.regexp_replace(t, r"(?U)[\x{A0}\s]+", " ")
    return F.trim(F.regexp_replace(t, r"(?<=[A-Za-z])(?=[Øø])", " "))


def halved(token: Column) -> Column:
    """A token whose characters all come twice in a row, once each (66//11 gives 6/1); others as they are."""
    return F.when(token.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(token, r"(.)\1", "$1")).otherwise(token)


def spatial_token(token: Column) -> Column:
    """A word's text without outer brackets and stops, without spaces, its doubled glyphs halved."""
    return halved(F.replace(F.btrim(F.trim(token), F.lit(",;:()[]{}")), F.lit(" "), F.lit("")))


def identifier_number(number: Column) -> Column:
    """Leading zeros gone from each part between . / and -."""
    return F.regexp_replace(F.trim(number), r"(^|[./-])0+(?=\d)", "$1")


def parsed_identifier(identifier: Column) -> Column:
    """Letters and number of a manhole upper-case and without leading zeros; anything else trimmed and upper-case; blank as it is."""
    plain = F.upper(F.trim(identifier))
    known = plain.rlike(rf"^(?:KD|KS|D|S|K){ID_NUMBER}$")
    joined = F.concat(F.regexp_extract(plain, "^([A-Z]+)", 1), identifier_number(F.regexp_extract(plain, "^[A-Z]+(.*)$", 1)))
    return F.when(F.trim(identifier) == "", identifier).when(known, joined).otherwise(plain)


def key_of(identifier: Column) -> Column:
    """The merge key: trimmed, upper-case, without spaces, \\ as /; empty for null. Zeros stay."""
    return F.translate(F.upper(F.trim(F.coalesce(identifier, F.lit("")))), "\\ ", "/")


def inlet_key(identifier: Column) -> Column:
    key = key_of(identifier)
    return F.when((key == "") | F.startswith(key, F.lit("WP")), key).otherwise(F.concat(F.lit("WP"), key))


def material(value: Column) -> Column:
    """Upper-case, PEHD and HDPE as PE-HD; null as empty."""
    plain = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.replace(F.replace(plain, F.lit("PEHD"), F.lit("PE-HD")), F.lit("HDPE"), F.lit("PE-HD"))


def manhole_type(value: Column) -> Column:
    low = F.lower(value)
    out = F.lit(None).cast("string")
    for part, name in reversed(TYPE_WORDS.items()):
        out = F.when(F.contains(low, F.lit(part)), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.trim(value))


def loose(value: Column) -> Column:
    """Without any white space, upper-case; null as empty."""
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s", ""))


def folded(value: Column) -> Column:
    """Lower-case, Polish letters as plain ones, without _ . + and spaces; null as empty."""
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), POLISH + "_.+ ", FOLDED)


def ocr_token(token: Column) -> Column:
    """Dashes alike, a misread 1 after an identifier's letters, and misread PVC put right."""
    t = F.translate(F.trim(token), "–—", "--")
    t = F.when(t.rlike(r"(?iu)^[DKSWP]{1,2}[Il|]\d"), F.regexp_replace(t, r"(?iu)([DKSWP]{1,2})[Il|](?=\d)", "$11")).otherwise(t)
    return F.regexp_replace(t, r"(?iu)^P[¥YV]C(?=\d)|^PVCI(?=\d)", "PVC")


def dedup_text(token: Column) -> Column:
    return F.regexp_replace(F.upper(token), r"[^A-Z0-9ĄĆĘŁŃÓŚŹŻØ./,-]", "")


def sort_key(identifier: Column, sub: bool = True, width: int = 6) -> Column:
    """Letters, the main number and (sub) the one after it plus 1, padded, so that text order is natural order; blank last.

    A missing main number counts as the largest.
    """
    plain = F.upper(F.trim(F.coalesce(identifier, F.lit(""))))
    letters = F.regexp_extract(plain, r"^(\p{L}*)", 1)
    rest = F.filter(F.split(F.substr(plain, F.length(letters) + 1), "[/.-]"), lambda c: c != "")
    number = lambda k, other: F.coalesce(F.get(rest, F.lit(k)).try_cast("int"), F.lit(other))
    parts = [letters, F.lpad(number(0, 10**width - 1).cast("string"), width, "0")]
    if sub:
        parts += [F.lit("."), F.lpad((number(1, -1) + 1).cast("string"), width, "0")]
    return F.when(plain == "", F.lit("ZZZ" + "9" * width)).otherwise(F.concat(*parts))


def shown_sort_key(identifier: Column) -> Column:
    """The key of lists on screen: as sort_key for letters, number and one index; the text itself, upper-case, for anything else."""
    plain = F.upper(F.trim(F.coalesce(identifier, F.lit(""))))
    pattern = r"^([A-Z]+)(\d+)?(?:[./-](\d+))?$"
    part = lambda g, other: F.coalesce(F.regexp_extract(plain, pattern, g).try_cast("int"), F.lit(other))
    key = F.concat(F.regexp_extract(plain, pattern, 1), F.lpad(part(2, 999_999).cast("string"), 6, "0"), F.lit("."), F.lpad((part(3, -1) + 1).cast("string"), 6, "0"))
    return F.when(plain == "", F.lit("ZZZ999999")).when(plain.rlike(pattern), key).otherwise(F.upper(identifier))


def for_log(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(""))


def short_error(messages: Column, kind: Column, n: int = 240) -> Column:
    """The innermost of nested messages (the last of an array), or the error's kind where it is blank, cut to n characters."""
    last = F.trim(F.coalesce(F.try_element_at(messages, F.lit(-1)), F.lit("")))
    return clipped(F.when(last == "", kind).otherwise(last), n)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def clipped(text: Column, n: int = 240) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def transitions_text(transitions: Column, ordered: bool = True) -> Column:
    """material DNd × quantity, by material and diameter (or as they come), joined by ' | '."""
    ordered = F.array_sort(transitions) if ordered else transitions
    return F.array_join(F.transform(ordered, lambda t: F.format_string("%s DN%d × %d", t["material"], t["diameter_mm"], t["quantity"])), " | ")


def lines(*streams: Column) -> Column:
    """Lines of the distinct non-blank streams in order, each normalised, blanks left out."""
    some = F.array_distinct(F.filter(F.array(*streams), lambda s: s.isNotNull() & (F.trim(s) != "")))
    all_ = F.flatten(F.transform(some, lambda s: F.split(s, r"\r\n|\r|\n")))
    return F.filter(F.transform(all_, extracted), lambda s: s != "")


def cell_address(column: Column, row: Column) -> Column:
    """Spreadsheet address of a column (1 to 702) and a row."""
    low = F.char(65 + (column - 1) % 26)
    high = F.char(64 + F.floor((column - 1) / 26))
    return F.concat(F.when(column > 26, high).otherwise(F.lit("")), low, row.cast("string"))
