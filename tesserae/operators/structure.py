"""Structure detection: what kind of headings a text has, where its sections start, and the slices between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import title_case

#: Patterns of the heading kinds.
TITLED = "(?i)(?:^|\\n)[ \\t]*(Capitolo|Chapter|Parte)\\s+\\S+\\s*[:\\-]"
NUMBERED = "(?:^|\\n)[ \\t]*\\d{1,3}[ \\t]*\\n"
CAPITALS = "(?:^|\\n)[ \\t]*([A-Z][A-Z\\s'\"À-Ü]{5,})[ \\t]*\\n"
#: Numbers that keyword headings stand for.
KEYWORDS: Mapping[str, int] = {"prologo": 0, "prologue": 0, "epilogo": 998, "epilogue": 998}


def kind(text: Column) -> Column:
    """`titled`, `numbered` or `capitals` by the most matches (ties in this order); none: `plain`."""
    counts = [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in (TITLED, NUMBERED, CAPITALS)]
    top = F.greatest(*counts)
    return F.when(top == 0, "plain").when(counts[0] == top, "titled").when(counts[1] == top, "numbered").otherwise("capitals")


def heading_rows(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_no, pos, line): lines with their start positions, counted in code points."""
    chosen = docs.where(F.col(text_col).rlike(f"{TITLED}|{NUMBERED}|{CAPITALS}"))
    rows = chosen.select(id_col, kind(F.col(text_col)).alias("kind"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int")
    return rows.select(id_col, "kind", "line_no", pos.alias("pos"), F.trim("raw").alias("line"))


def headings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, kind, pos, number, title): the headings of each text's own kind; numbers only where the kind has them, the
    first of each number by position."""
    rows = heading_rows(docs, id_col, text_col)
    keyword = F.try_element_at(F.create_map(*[F.lit(v) for item in KEYWORDS.items() for v in item]), F.lower("line"))
    appendix = F.when(F.col("line").rlike("(?i)^(Coda|Cado|Appendice|Appendix)\\s+\\d+\\s*[:\\-]"), 900 + F.coalesce(F.regexp_extract("line", "(\\d+)", 1).try_cast("int"), F.lit(0)))
    bare = F.when(F.col("line").rlike("^\\d{1,3}$"), F.col("line").try_cast("int"))
    number = F.coalesce(keyword, appendix, bare)
    numbered = rows.where("kind = 'numbered'").withColumn("number", number).where(F.col("number").isNotNull())
    first = Window.partitionBy(id_col, "number").orderBy("pos")
    numbered = numbered.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    titled = rows.where("kind = 'titled'").where(F.col("line").rlike("(?i)^(Capitolo|Chapter|Parte)\\s+\\S+\\s*[:\\-]")).withColumn("number", F.lit(None).cast("int"))
    capitals = rows.where("kind = 'capitals'").where(F.col("line").rlike("^[A-Z][A-Z\\s'\"À-Ü]{5,}$")).withColumn("number", F.lit(None).cast("int"))
    prefix = F.substring_index("line", " ", 2)
    # dominant series of capitals: a prefix that comes twice at least and is spread over the text
    lengths = docs.select(F.col(id_col).alias("__id"), F.length(text_col).alias("chars"))
    clusters = (
        capitals.withColumn("prefix", prefix)
        .groupBy(id_col, "prefix")
        .agg(F.count(F.lit(1)).alias("n"), (F.max("pos") - F.min("pos")).alias("spread"))
        .join(lengths, F.col(id_col) == F.col("__id"))
        .where((F.col("n") >= 2) & (F.col("spread") >= 0.5 * F.col("chars") / F.col("n")))
        .select(F.col(id_col).alias("__id"), F.col("prefix").alias("__prefix"))
    )
    dominant = capitals.join(clusters, (F.col(id_col) == F.col("__id")) & (prefix == F.col("__prefix")), "left_semi").withColumn("line", title_case(F.col("line")))
    columns = [id_col, "kind", "pos", "number", F.col("line").alias("title")]
    return titled.select(*columns).unionByName(numbered.select(*columns)).unionByName(dominant.select(*columns))


def slices(marks: DataFrame, docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, section_index, section_title, start_pos, end_pos): from each mark to the next or the text's end; without marks
    one section at 0. marks: (id, pos, title)."""
    lengths = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    w = Window.partitionBy("__id").orderBy("pos", "title")
    joined = lengths.join(marks.select(F.col(id_col).alias("__m"), "pos", "title"), F.col("__id") == F.col("__m"), "left")
    placed = joined.withColumn("pos", F.coalesce("pos", F.lit(0))).withColumn("title", F.coalesce("title", F.lit("Section 001")))
    return placed.select(
        F.col("__id").alias(id_col),
        F.row_number().over(w).alias("section_index"),
        F.col("title").alias("section_title"),
        F.col("pos").alias("start_pos"),
        F.lead("pos", 1).over(w).alias("next_pos"),
        "chars",
    ).select(id_col, "section_index", "section_title", "start_pos", F.coalesce("next_pos", "chars").alias("end_pos"))


def boundaries(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Detected sections of every text."""
    return slices(headings(docs, id_col, text_col), docs, id_col, text_col)


def profile_number(title: Column) -> Column:
    """The heading number that a profile's title stands for: a plain integer, a prologue or epilogue, or the n-th coda or appendix."""
    t = F.trim(title)
    coda = F.regexp_extract(F.lower(t), "^(?:coda|cado|appendice|appendix)\\s+(\\d+)", 1)
    keyword = F.try_element_at(F.create_map(*[F.lit(v) for item in KEYWORDS.items() for v in item]), F.lower(t))
    return F.coalesce(F.when(coda != "", 900 + coda.try_cast("int")), keyword, t.try_cast("int"))


def match_profile(detected: DataFrame, profile: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, section, name): detected numbered headings (id, pos, number) under the names of a profile (id, section from 1, name).

    Sections are met by the numbers their titles stand for; if at least half of a profile's sections (and one) are met, those are the result, else the
    first headings are given the first names by position."""
    p = profile.select(F.col(id_col).alias("__id"), "section", "name", profile_number(F.col("name")).alias("__number"))
    of_number = p.where("__number is not null").groupBy("__id", "__number").agg(F.max_by(F.struct("section", "name"), "section").alias("s"))
    met = detected.join(of_number, (F.col(id_col) == F.col("__id")) & (F.col("number") == F.col("__number"))).select(id_col, "s.section", "s.name", "pos")
    met = met.groupBy(id_col, "section", "name").agg(F.max("pos").alias("pos"))
    sizes = p.groupBy("__id").agg(F.count(F.lit(1)).alias("__n"))
    hits = met.groupBy(F.col(id_col).alias("__m")).agg(F.count(F.lit(1)).alias("__met"))
    enough = sizes.join(hits, F.col("__id") == F.col("__m"), "left").select("__id", (F.coalesce("__met", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("__n") / 2))).alias("__enough"))
    by_number = met.join(enough.where("__enough").select("__id"), F.col(id_col) == F.col("__id"), "left_semi")
    placed = detected.withColumn("__place", F.row_number().over(Window.partitionBy(id_col).orderBy("pos", "number")))
    by_place = placed.join(p.drop("__number"), (F.col(id_col) == F.col("__id")) & (F.col("__place") == F.col("section"))).drop("__id")
    by_place = by_place.join(enough.where("not __enough").select("__id"), F.col(id_col) == F.col("__id"), "left_semi")
    columns = [id_col, "pos", "section", "name"]
    return by_number.select(*columns).unionByName(by_place.select(*columns))


def locate_titles(docs: DataFrame, profile: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, section, name, pos): where the titles of a profile (id, section, name) head a line of the text. Only the part before `: ` is looked
    for, in any case, and only if it begins with a heading word; titles without one, or not found, are at 0."""
    p = profile.select(F.col(id_col).alias("__id"), "section", "name", F.trim(F.substring_index("name", ": ", 1)).alias("__prefix"))
    got = docs.select(id_col, F.col(text_col).alias("__text")).join(p, F.col(id_col) == F.col("__id"))
    worded = F.lower("__prefix").rlike("^(capitolo|chapter|parte) ")
    pattern = F.concat(F.lit("(?isu)^(.*?)(^|\\n)[ \\t]*"), F.regexp_replace("__prefix", "([\\\\^$.|?*+()\\[\\]{}])", "\\\\$1"))
    before = F.expr("length(regexp_extract(__text, __pattern, 1)) + length(regexp_extract(__text, __pattern, 2))")
    return got.withColumn("__pattern", pattern).select(id_col, "section", "name", F.when(worded, before).otherwise(0).alias("pos"))


def section_positions(docs: DataFrame, id_col: str, text_col: str, sections: DataFrame, name: str) -> DataFrame:
    """(id, name, pos): where each of a text's sections (id, name) first occurs in it; sections that do not occur are left out."""
    s = sections.select(F.col(id_col).alias("__id"), F.col(name).alias("name"))
    joined = s.join(docs.select(F.col(id_col), F.col(text_col).alias("__text")), F.col("__id") == F.col(id_col))
    return joined.select(id_col, "name", F.instr("__text", F.col("name")).alias("p")).where("p > 0").select(id_col, "name", (F.col("p") - 1).alias("pos"))


def section_blocks(positions: DataFrame, docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, block, start_pos, end_pos, sections): whole sections packed greedily into blocks of at most `limit` characters (a
    longer section is a block of its own); the first block starts at 0."""
    from .ordered import fold_budget

    lengths = docs.select(F.col(id_col).alias("__id"), F.length(text_col).alias("chars"))
    w = Window.partitionBy(id_col).orderBy("pos")
    spans = positions.join(lengths, F.col(id_col) == F.col("__id")).withColumn("end", F.coalesce(F.lead("pos").over(w), F.col("chars"))).withColumn("from", F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("pos")))
    listed = spans.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("from", "end", "name"))).alias("s"))
    sizes = F.transform("s", lambda x: x["end"] - x["from"])
    flat = listed.select(id_col, F.explode(F.arrays_zip(F.col("s"), fold_budget(sizes, limit).alias("block"))).alias("z"))
    rows = flat.select(id_col, "z.block", "z.s.*")
    return rows.groupBy(id_col, "block").agg(F.min("from").alias("start_pos"), F.max("end").alias("end_pos"), F.count(F.lit(1)).alias("sections"))
