"""Rows from text: identifiers, inlets, pipes and their properties by regular expressions, first occurrence kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plansift.functions import rules, text

# Patterns that results depend on, in Java's syntax.
MANHOLE = r"(?iu)\b(?:(KD|KS|D|S)\s*[-.:]?\s*(\d{1,3}(?:[./-]\d+)*)|(SO))\b"
INLET = r"(?iu)\bWP\s*(\d{1,3}(?:[./-]\d+)*)\b"
SHORT_INLET = r"^W\s*([0-8])$"
DIAMETER = r"(?iu)\b(DN|D)\b[:=\s]*([0-9]{1,4})\b"
ANY_MATERIAL = r"(?iu)\b(PE-HD|PEHD|HDPE|PVC|PP|PE|Concrete|Beton|Żelbet)\b"
MATERIAL_DIAMETER = r"(?iu)\b(PE-HD|PEHD|HDPE|PVC|PP|PE)\b[^\d\r\n]{0,6}[Øø]?\s*(\d{2,4})\b"
SEPARATOR = r"(?iu)\b(separator|osadnik|osadniki?)\b(?:[^\d\r\n]{0,20}[Øø]?\s*(\d{2,4}))?"
COMPACT_PIPE = r"(?iu)(P\d+)?(PE-HD|PEHD|HDPE|PVC|PP|PE)\s*[Øø]?\s*(\d{2,4})(?:\b|(?=i=|%))"
PE_SERIES = r"(?iu)(PE)\s+szereg\s+SDR\s*(\d{1,3})(?:\s+PN\s*(\d{1,3}))?"
PVC_U = r"(?iu)\bPVC-U(?:[_\s-]*SDR\s*\d+[_\s]*(?:L|I|1))?\s*(\d{2,4})\s*[x×]"
BARE_BEFORE_SLOPE = r"(?iu)(?:^|\r?\n)[ \t]*(160|200|225|250|300|315|400|500|600|630|800)[ \t]*(?:\r?\n)[ \t]*\d{1,2}(?:[,.]\d+)?[ \t]*%"
CONCRETE_SCHEDULE = r"(?iu)\bD[ \t]*(\d{2,4})[ \t]*(?:\r?\n[ \t]*)?(?:beton(?:owe|owy|owa)?|żelbet(?:owe|owy|owa)?)\b"
CONCRETE_LEGEND = r"(?iu)\b(\d{2,4})[ \t]+(?:beton(?:owe|owy|owa)?|żelbet(?:owe|owy|owa)?)\b(?=[^\r\n]{0,80}WIPRO)"
DIAMETER_MATERIAL = r"(?iu)\bD[zż]?[ \t]*(\d{2,4})[ \t]*(?:mm)?[ \t]*(PVC|PE-HD|PEHD|HDPE|PP|PE)\b"
TYPE = r"(?iu)\b(kinetow(?:a|e|y)?|osadnik(?:ow(?:a|e|y)?)?|rozpr[eę]żn(?:a|e|y)?|czyszczak(?:ow(?:a|e|y)?)?|tłocz(?:ny|na|ne)?)\b"
HEIGHT = r"(?iu)\b(?:wys(?:okość)?\.?(?:\s*całk(?:owita)?\.?)?|H)\s*[:=]?\s*(\d{1,2}(?:[,.]\d{1,3})?)\s*m\b"
CROWN = r"(?iu)\b(właz\s+[^,;]{1,45}|pokrywa\s+[^,;]{1,45}|pokrycie\s+[^,;]{1,45}|zwieńczenie\s+[^,;]{1,55}|klasa\s+[A-Za-z0-9]+)\b"
# concrete isn't a pipe's if a word for manhole lies within the 28 characters before it
TRANSITION = r"(?iu)(?<![A-Za-z0-9])(PE-HD|PEHD|HDPE|PVC|PP|PE|(?<!studni[aeyą].{0,21})(?<!studzienk[ai].{0,18})(?:Żelbet|Beton))\s*(?:DN|D|Ø|ø)?\s*(\d{2,4})(?!\d)"
NAMED_MANHOLE = r"(?iu)\b(studnia|studzienka|studni[aą])\b(?:[^\d\r\n]{0,30}[Øø]?\s*(\d{2,4}))?"
LINE_CROWN = r"(?iu)\b(właz\s+[^\s,;]+(?:\s+[^\s,;]+)?|pokrycie\s+[^\s,;]+(?:\s+[^\s,;]+)?|zwieńczenie\s+[^\s,;]+(?:\s+[^\s,;]+)?|klasa\s+[A-Za-z0-9]+)\b"
LINE_TRANSITION = r"(?iu)\b(PE-HD|PEHD|HDPE|PVC|PP|PE|Żelbet|Beton)\b[^\dA-Za-z]{0,6}?(?:DN|Ø|ø)?\s*(\d{2,4})\b"
NOTHING = "BRAK DANYCH"
COVER_CLASS = r"(?iu)\bklas[ay]\s+D\s*400\b"
PIPE_400 = r"(?iu)\b(?:PVC-U|PVC|PE-HD|PEHD|HDPE|PP|PE)\b[^\r\n]{0,20}\b(?:DN|D|Ø|ø)\s*400\b"
NEAR_MANHOLE = r"(?iu)\b(?:studnia|studzienka)\b.{0,80}?(?:DN|D|Ø|ø)\s*(\d{3,4})\b"
ANY_DIAMETER = r"(?iu)\b(?:DN|D|Ø|ø)\s*(\d{3,4})\b"
ID_ELEVATIONS = r"(?iu)\b((?:KD|KS|D|S)\s*\d{1,3}(?:[./-]\d+)*|SO)\b\s*(\d{2,3}[.,]\d{2})\s+(\d{2,3}[.,]\d{2})"


def matches(value: Column, pattern: str, *groups: int) -> Column:
    """array<struct<g0, g1, ...>> of the matches' groups, in order."""
    found = [F.regexp_extract_all(value, F.lit(pattern), F.lit(g)) for g in groups]
    return F.arrays_zip(*[f.alias(f"g{k}") for k, f in enumerate(found)]) if len(found) > 1 else F.transform(found[0], lambda v: F.struct(v.alias("g0")))


def exploded(rows: DataFrame, value: Column, pattern: str, *groups: int) -> DataFrame:
    """A row per match: rows' columns, pos (its place among the matches) and g0, g1, ..."""
    out = rows.select("*", F.posexplode(matches(value, pattern, *groups)).alias("pos", "_g"))
    return out.select("*", *[F.col("_g")[f"g{k}"].alias(f"g{k}") for k in range(len(groups))]).drop("_g")


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, line: the distinct text streams of a page, line by line, normalised."""
    streams = [F.col(c) for c in ("text", "raw_text", "ordered_text") if c in pages.columns]
    return pages.select("doc_id", "page_no", F.posexplode(text.lines(*streams)).alias("line_no", "line"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; nulls in keys are alike."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def built_identifier(letters: Column, number: Column, special: Column) -> Column:
    """The identifier of a match of MANHOLE: letters and number, or the special name."""
    return F.when(special != "", F.upper(special)).otherwise(F.concat(F.upper(letters), text.identifier_number(number)))


def manholes(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, identifier, line_no, pos, raw_text (the words matched): plausible identifiers of lines, once per page."""
    rows = exploded(lines, F.col("line"), MANHOLE, 0, 1, 2, 3)
    rows = rows.withColumn("identifier", built_identifier(F.col("g1"), F.col("g2"), F.col("g3"))).where(rules.likely_identifier(F.col("identifier")))
    return first_of(rows, ["doc_id", "page_no", "identifier"], ["line_no", "pos"]).select("doc_id", "page_no", "identifier", "line_no", "pos", F.col("g0").alias("raw_text"))


def line_transitions(line: Column) -> Column:
    """array<struct<material, diameter_mm, quantity>> of a line, in the order of first mention; diameters from 20 on."""
    found = F.transform(matches(line, LINE_TRANSITION, 1, 2), lambda m: F.struct(F.upper(m["g0"]).alias("material"), m["g1"].cast("int").alias("diameter_mm")))
    found = F.filter(found, lambda m: m["diameter_mm"] >= 20)
    return F.transform(F.array_distinct(found), lambda m: F.struct(m["material"], m["diameter_mm"], F.size(F.filter(found, lambda o: o == m)).alias("quantity")))


def described_manholes(lines: DataFrame) -> DataFrame:
    """A row for each word for manhole in a line: what the line tells of type, diameter, height, crown and transitions.

    identifier: the line's first one, or else the matched words. raw_text: all of it in one note (a fixed form).
    """
    rows = exploded(lines, F.col("line"), NAMED_MANHOLE, 0, 2)
    named = [F.regexp_extract("line", MANHOLE, g) for g in range(4)]
    words = F.trim("g0")
    rows = rows.select(
        "doc_id", "page_no", "line_no", "pos",
        F.when(named[0] != "", built_identifier(*named[1:])).otherwise(words).alias("identifier"),
        F.coalesce(nothing_as_null(F.regexp_extract(words, r"(?iu)\b(?:DN|Ø|ø)?\s*(\d{3,4})\b", 1)), nothing_as_null(F.col("g1"))).cast("int").alias("diameter_mm"),
        nothing_as_null(F.trim(F.regexp_extract("line", TYPE, 1))).alias("type"),
        nothing_as_null(F.regexp_extract("line", HEIGHT, 1)).alias("_height"),
        nothing_as_null(F.trim(F.regexp_extract("line", LINE_CROWN, 1))).alias("crown"),
        line_transitions(F.col("line")).alias("transitions"), words.alias("_words"),
    )
    told = lambda c: F.coalesce(c, F.lit(NOTHING))
    moved = F.array_join(F.transform("transitions", lambda t: F.format_string("%s DN%d × %d", t["material"], t["diameter_mm"], t["quantity"])), " | ")
    dn = F.when(F.col("diameter_mm") > 0, F.concat(F.lit("DN"), F.col("diameter_mm").cast("string")))
    parts = {"Name": F.col("identifier"), "Type": told(F.col("type")), "Diameter": told(dn), "Height": told(F.concat("_height", F.lit(" m"))), "Crown": told(F.col("crown")), "Transitions": told(nothing_as_null(moved)), "RawDesc": F.col("_words")}
    note = F.concat_ws(";", *[F.concat(F.lit(f"{k}:"), v) for k, v in parts.items()])
    positive = F.when(F.col("diameter_mm") > 0, F.col("diameter_mm"))
    return rows.withColumns({"raw_text": note, "height_m": number(F.col("_height")), "diameter_mm": positive}).drop("_height", "_words")


def text_manholes(lines: DataFrame) -> DataFrame:
    """One row per page and identifier (whatever the case) out of identifiers and descriptions in lines, in their order.

    The first that tells something wins; quantities of transitions add up. Columns of page_records.
    """
    bare = manholes(lines).select("doc_id", "page_no", "line_no", F.lit(0).alias("_stage"), "pos", "identifier", "raw_text", *[F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("diameter_mm", "int"), ("height_m", "double"), ("crown", "string"), ("transitions", TRANSITIONS))])
    told = described_manholes(lines).withColumn("_stage", F.lit(1)).select(bare.columns)
    rows = bare.unionByName(told).withColumns({"_at": F.struct("line_no", "_stage", "pos"), "_id": F.upper("identifier")})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    out = rows.groupBy("doc_id", "page_no", "_id").agg(
        F.min("_at").alias("_first"), F.min_by("identifier", "_at").alias("identifier"), F.min_by("raw_text", "_at").alias("raw_text"),
        first("type"), first("diameter_mm"), first("height_m"), first("crown"), F.flatten(F.collect_list("transitions")).alias("_all"),
    )
    return out.withColumns({"transitions": summed("_all"), "place": F.struct(F.lit(2).alias("stage"), F.col("_first.line_no").cast("double").alias("a"), F.col("_first._stage").cast("double").alias("b"), F.col("_first.pos").cast("double").alias("c"))}).drop("_id", "_first", "_all")


#: The transitions of one record.
TRANSITIONS = "array<struct<material:string,diameter_mm:int,quantity:int>>"


def summed(transitions: str | Column) -> Column:
    """Transitions with the quantities of equal material (whatever the case) and diameter added up, ordered by both."""
    all_ = F.col(transitions) if isinstance(transitions, str) else transitions
    keys = F.array_sort(F.array_distinct(F.transform(all_, lambda t: F.struct(F.upper(t["material"]).alias("material"), t["diameter_mm"].alias("diameter_mm")))))
    total = lambda k: F.aggregate(F.filter(all_, lambda t: (F.upper(t["material"]) == k["material"]) & (t["diameter_mm"] == k["diameter_mm"])), F.lit(0), lambda a, t: a + t["quantity"].cast("int"))
    return F.transform(keys, lambda k: F.struct(k["material"], k["diameter_mm"], total(k).alias("quantity"))).cast(TRANSITIONS)


def inlets(lines: DataFrame) -> DataFrame:
    """Inlets WPn of lines, and Wn where it is the whole line, once per page."""
    long = exploded(lines, F.col("line"), INLET, 0, 1)
    short = exploded(lines, F.col("line"), SHORT_INLET, 0, 1)
    rows = long.unionByName(short).withColumns({"identifier": F.concat(F.lit("WP"), text.identifier_number(F.col("g1"))), "m": F.col("g0")})
    out = first_of(rows, ["doc_id", "page_no", "identifier"], ["line_no", "pos"])
    return out.select("doc_id", "page_no", "identifier", F.col("m").alias("raw_text"), F.lit("średnia").alias("confidence"))


def schedule_pipes(pages: DataFrame) -> DataFrame:
    """Pipes of profile schedules, from text as it is: doc_id, page_no, stage, pos, diameter_mm, material, raw_text."""
    plain = pages.withColumn("_t", F.concat_ws("\n", *[F.col(c) for c in ("text", "raw_text", "ordered_text") if c in pages.columns]))

    def found(pattern, stage, name, diameter=1, low=50, high=2000, material_group=None):
        groups = (0, diameter, material_group) if material_group else (0, diameter)
        rows = exploded(plain, F.col("_t"), pattern, *groups).withColumn("diameter_mm", F.col("g1").cast("int")).where(F.col("diameter_mm").between(low, high))
        return rows.select("doc_id", "page_no", F.lit(stage).alias("stage"), "pos", "diameter_mm", (text.material(F.col("g2")) if material_group else F.lit(name)).alias("material"), F.trim("g0").alias("raw_text"))

    # a bare diameter before a slope counts if PVC-U was named in the 240 characters before it and no other material since
    gaps = F.split(F.col("_t"), BARE_BEFORE_SLOPE, -1)
    bare = plain.withColumn("_gaps", gaps).select("*", F.posexplode(matches(F.col("_t"), BARE_BEFORE_SLOPE, 0, 1)).alias("pos", "_g"))
    before = F.aggregate(F.slice("_gaps", F.lit(1), F.col("pos") + 1), F.lit(""), lambda acc, g: F.concat(acc, F.lit(" "), g))
    near = F.expr("right(_before, 240)")
    bare = bare.withColumn("_before", before).withColumn("_near", near)
    since = F.regexp_extract(F.col("_near"), r"(?ius).*PVC-U(.*)$", 1)
    bare = bare.where(F.col("_near").rlike("(?iu)PVC-U") & ~since.rlike(r"(?iu)\b(?:PE-HD|PEHD|HDPE|PP|PE|beton|żelbet)"))
    bare = bare.select("doc_id", "page_no", F.lit(1).alias("stage"), "pos", F.col("_g.g1").cast("int").alias("diameter_mm"), F.lit("PVC").alias("material"), F.trim("_g.g0").alias("raw_text"))
    parts = [found(PVC_U, 0, "PVC"), bare, found(CONCRETE_SCHEDULE, 2, "BETON", low=100), found(CONCRETE_LEGEND, 3, "BETON", low=100), found(DIAMETER_MATERIAL, 4, None, material_group=2)]
    return first_of(reduce(DataFrame.unionByName, parts), ["doc_id", "page_no", "diameter_mm", "material"], ["stage", "pos"])


def line_pipes(lines: DataFrame) -> DataFrame:
    """All pipes that lines name, repeated ones too (see kept_pipes): by DN or D with the line's first material (stage 10), material
    then diameter (11), series (12), compact notes (13), material alone (14), separators (15). raw_text: the words matched."""
    null = F.lit(None).cast("string")
    own = nothing_as_null(F.regexp_extract("line", ANY_MATERIAL, 1))

    def found(pattern, stage, diameter, material, *groups, keep=F.lit(True)):
        rows = exploded(lines, F.col("line"), pattern, 0, *groups).withColumn("diameter_mm", diameter)
        return rows.where(keep).select("doc_id", "page_no", "line_no", F.lit(stage).alias("stage"), "pos", "diameter_mm", material.alias("material"), F.col("g0").alias("raw_text"))

    mm = lambda g: nothing_as_null(F.col(g)).cast("int")
    some = F.when(mm("g2") > 0, mm("g2"))
    parts = [
        found(DIAMETER, 10, mm("g2"), own, 1, 2, keep=(F.upper("g1") == "DN") | (F.col("diameter_mm") >= 100)),
        found(MATERIAL_DIAMETER, 11, some, F.col("g1"), 1, 2),
        found(PE_SERIES, 12, F.lit(None).cast("int"), F.col("g1"), 1),
        found(COMPACT_PIPE, 13, mm("g2"), F.col("g1"), 2, 3, keep=F.col("diameter_mm") >= 20),
        found(ANY_MATERIAL, 14, F.lit(None).cast("int"), F.col("g1"), 1),
        found(SEPARATOR, 15, some, null, 1, 2),
    ]
    return reduce(DataFrame.unionByName, parts)


def kept_pipes(pipes: DataFrame) -> DataFrame:
    """The pipes that a page keeps of all that it names, in the order of lines, stages and places.

    By diameter or by material and diameter: the first of each diameter and material. Compact notes: unless those words already stand
    for that diameter and material. A material alone: unless an earlier pipe of it has a diameter, and once per words. Series and
    separators: once per words. Whatever the case, always.
    """
    page, at = ["doc_id", "page_no"], ["line_no", "stage", "pos"]
    rows = pipes.withColumns({"_m": F.upper(F.coalesce("material", F.lit(""))), "_r": F.upper("raw_text")})
    sized = rows.where((F.col("stage") < 12) | (F.col("stage") == 13))
    whole = sized.withColumn("_n", F.row_number().over(Window.partitionBy(*page, "diameter_mm", "_m").orderBy(*at))).where((F.col("_n") == 1) | (F.col("stage") == 13)).drop("_n")
    whole = whole.withColumn("_n", F.row_number().over(Window.partitionBy(*page, "diameter_mm", "_m", "_r").orderBy(*at))).where((F.col("_n") == 1) | (F.col("stage") != 13)).drop("_n")
    first = whole.where("diameter_mm > 0").groupBy(*page, "_m").agg(F.min(F.struct(*at)).alias("_seen"))
    alone = first_of(rows.where("stage = 14"), [*page, "_m", "_r"], at).join(first, [*page, "_m"], "left")
    alone = alone.where(F.col("_seen").isNull() | (F.col("_seen") > F.struct(*at))).drop("_seen")
    others = first_of(rows.where("stage IN (12, 15)"), [*page, "_r"], at)
    return whole.unionByName(alone).unionByName(others).drop("_m", "_r")


def all_text(pages: DataFrame) -> Column:
    return F.concat_ws("\n", *[F.col(c) for c in ("text", "raw_text", "ordered_text") if c in pages.columns])


def without_cover_class(pipes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pipes without DN400 on pages that name cover class D 400 and no pipe of that diameter, in words or of concrete among the pipes."""
    page = ["doc_id", "page_no"]
    t = all_text(pages)
    marked = pages.where(t.rlike(COVER_CLASS) & ~t.rlike(PIPE_400)).select(*page).distinct()
    real = pipes.where((F.col("diameter_mm") == 400) & (F.upper("material") == "BETON")).select(*page).distinct()
    marked = marked.join(real, page, "left_anti").withColumn("diameter_mm", F.lit(400))
    return pipes.join(marked, [*page, "diameter_mm"], "left_anti")


def without_material_only(pipes: DataFrame) -> DataFrame:
    """Pipes without a diameter go where the page has the material with one."""
    rows = pipes.withColumn("_m", F.upper("material"))
    known = rows.where(F.col("diameter_mm").isNotNull() & rules.filled(F.col("material"))).select("doc_id", "page_no", "_m").distinct()
    bare = rows.where(F.col("diameter_mm").isNull()).join(known, ["doc_id", "page_no", "_m"], "left_anti")
    return rows.where(F.col("diameter_mm").isNotNull()).unionByName(bare).drop("_m")


def without_misread(pipes: DataFrame, on: Column, repeated: DataFrame) -> DataFrame:
    """Pipes without those that OCR misread from profiles (where `on` holds). repeated: page and diameter of rows of manholes' diameters."""
    marks = repeated.select("doc_id", "page_no", "diameter_mm").distinct().withColumn("_repeated", F.lit(True))
    rows = pipes.join(marks, ["doc_id", "page_no", "diameter_mm"], "left")
    keeps = rules.keeps_ocr_pipe(F.col("material"), F.col("diameter_mm"), F.coalesce("_repeated", F.lit(False)))
    return rows.where(~on | keeps).drop("_repeated")


def simple_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, kind, line: each line of the text as a manhole, an inlet or a pipe by the first sign of one; others left out."""
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"[\r\n]+")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    pipe = F.col("line").rlike(r"(?iu)\b(?:KD|KS|D|Wp|DN)\b|PVC|PP|PE|Concrete")
    kind = F.when(F.col("line").rlike(r"(?iu)\b(?:KD|KS)\b"), "manhole").when(F.col("line").rlike(r"(?iu)\bWp\b"), "inlet").when(pipe, "pipe")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "page_no", "line_no", "kind", "line")


def identifier_counts(pages: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, page_no, identifier, n: how often a page's text names each plausible identifier."""
    rows = exploded(pages.select("doc_id", "page_no", F.col(column).alias("_t")), F.col("_t"), MANHOLE, 1, 2, 3)
    rows = rows.withColumn("identifier", built_identifier(F.col("g0"), F.col("g1"), F.col("g2"))).where(rules.likely_identifier(F.col("identifier")))
    return rows.groupBy("doc_id", "page_no", "identifier").agg(F.count("*").alias("n"))


def number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def nothing_as_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def likely_diameter(context: Column) -> Column:
    """The manhole diameter of a text: the one beside the word for manhole, else a preferred one, else the largest plausible."""
    near = F.regexp_extract(context, NEAR_MANHOLE, 1).try_cast("int")
    some = F.filter(F.transform(F.regexp_extract_all(context, F.lit(ANY_DIAMETER), F.lit(1)), lambda d: d.cast("int")), rules.plausible_manhole_diameter)
    preferred = F.filter(F.array(*map(F.lit, rules.PREFERRED_DIAMETERS)), lambda d: F.array_contains(some, d))
    return F.coalesce(F.when(rules.plausible_manhole_diameter(near), near), F.get(preferred, F.lit(0)), F.array_max(some))


def described(context: str) -> dict[str, Column]:
    """Type, height, crown and diameter that a text tells of a manhole."""
    c = F.col(context)
    return {
        "type": F.when(c.rlike(TYPE), text.manhole_type(F.regexp_extract(c, TYPE, 1))),
        "height_m": number(F.regexp_extract(c, HEIGHT, 1)),
        "crown": nothing_as_null(F.trim(F.regexp_extract(c, CROWN, 1))),
        "diameter_mm": likely_diameter(c),
    }


def transitions(rows: DataFrame, context: str, by: list[str]) -> DataFrame:
    """by, material, diameter_mm, quantity: how often a text names a pipe's passage."""
    found = exploded(rows, F.col(context), TRANSITION, 1, 2).where(F.col("g1").cast("int") >= 20)
    found = found.select(*by, text.material(F.col("g0")).alias("material"), F.col("g1").cast("int").alias("diameter_mm"))
    return found.groupBy(*by, "material", "diameter_mm").agg(F.count("*").alias("quantity"))


def text_elevations(pages: DataFrame) -> DataFrame:
    """identifier, ground_m, invert_m of `identifier a b` in text: the larger is ground; the last mention on a page counts."""
    rows = exploded(pages.withColumn("_t", F.translate("text", "\r\n", "  ")), F.col("_t"), ID_ELEVATIONS, 1, 2, 3)
    rows = rows.select("doc_id", "page_no", "pos", text.parsed_identifier(F.regexp_replace("g0", r"\s", "")).alias("identifier"), rules.elevation(F.col("g1")).alias("a"), rules.elevation(F.col("g2")).alias("b"))
    rows = rows.where(F.abs(F.col("a") - F.col("b")).between(0.2, 15) & rules.likely_identifier(F.col("identifier")))
    out = rows.groupBy("doc_id", "page_no", "identifier").agg(F.max_by(F.struct(F.greatest("a", "b").alias("g"), F.least("a", "b").alias("i")), "pos").alias("v"))
    return out.select("doc_id", "page_no", "identifier", F.col("v.g").alias("ground_m"), F.col("v.i").alias("invert_m"))
