"""Headers of statements, hidden text and what tells a header from prose."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_a
from .layout import PAGE, banded, inside, islands, numbered

# How far header lines are looked for, how near words form a phrase, words that headers may hold besides periods.
MOST_LINES, MOST_GAP, PHRASE_GAP, WINDOW = 18, 30.0, 6.0, 7
VISIBLE, MARGIN = 1.0, 5.0
VOCABULARY = ("particulars", "for", "the", "year", "ended", "as", "at", "on", "period", "months", "fiscal", "note", "notes", "no", "in", "rs", "lakhs", "million", "crores", "consolidated", "standalone", "restated", "audited", "march")
BASES = ("consolidated", "standalone")


def lines_by_head(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """words with line: from the top down, a word joins a line if its top lies within tolerance of the line's first word."""

    return numbered(words, [F.rint(F.col("top") * 10), F.col("x0"), F.col("word_no")], F.col("top").cast("double"), lambda _: F.lit(tolerance), False)


def header_band(lines: DataFrame, most_lines: int = MOST_LINES, most_gap: float = MOST_GAP) -> DataFrame:
    """doc_id, page, line, data_line: header lines above the first data line below them.

    The scan goes up from a data line and stops at an earlier data line, a caption, a gap of over most_gap, or after
    most_lines lines: nothing between a header line and its data may stop it. lines: doc_id, page, line, top, bottom,
    is_data, is_caption, is_header.
    """
    down = Window.partitionBy(*PAGE).orderBy("line")
    below = F.lead("top").over(down)
    data = F.first(F.when(F.col("is_data"), F.col("line")), ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))
    seen = lines.withColumns({"data_line": data, "stops": F.col("is_caption") | F.coalesce(below - F.col("bottom") > most_gap, F.lit(False))})
    above = seen.where("data_line is not null and not is_data")
    up = Window.partitionBy(*PAGE, "data_line").orderBy(F.col("line").desc()).rowsBetween(Window.unboundedPreceding, 0)
    free = above.withColumn("stopped", F.bool_or("stops").over(up))
    return free.where(F.col("is_header") & ~F.col("stopped") & (F.col("data_line") - F.col("line") <= most_lines)).select(*PAGE, "line", "data_line")


def phrases(words: DataFrame, gap: float = PHRASE_GAP) -> DataFrame:
    """Words of a line no further apart than gap, as phrases: doc_id, page, line, phrase, x (its middle), text. words: doc_id, page, line, x0, x1, text."""
    before = F.lag("x1").over(Window.partitionBy(*PAGE, "line").orderBy("x0"))
    run = islands(words.withColumn("apart", F.col("x0") - before), [*PAGE, "line"], "x0", F.col("apart").isNull() | (F.col("apart") > gap), "phrase")
    in_order = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return run.groupBy(*PAGE, "line", "phrase").agg(((F.min("x0") + F.max("x1")) / 2).alias("x"), F.array_join(F.transform(in_order, lambda t: t["text"]), " ").alias("text"))


def bounds(anchors: DataFrame, alone: float = 60.0) -> DataFrame:
    """doc_id, page, col, x: where each column begins, midway to the one before; the first as far left of its anchor (J12). anchors: doc_id, page, col, at."""
    by = Window.partitionBy(*PAGE).orderBy("at")
    before, after = F.lag("at").over(by), F.lead("at").over(by)
    return anchors.select(*PAGE, "col", F.coalesce((before + F.col("at")) / 2, F.col("at") - (after - F.col("at")) / 2, F.col("at") - alone).alias("x"))


def headed(phrases_: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, page, no, col: the column that each phrase is centred over, null for labels left of all. phrases_: doc_id, page, no, x."""
    return banded(phrases_, bounds(anchors))


def period_windows(words: DataFrame, by: list[str]) -> DataFrame:
    """by, first, last, label: periods that the words of a cell spell, left to right.

    From the first word on, the shortest window of up to WINDOW words that reads as a period is taken, its start moved right
    while the reading stays the same, and the search goes on behind it. Headers repeat from page to page, so each wording is
    searched once and meets its cells again. words: by, word_no (from 0), text.
    """
    cell = words.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]).alias("words"))
    starts = cell.select("words").distinct().select("words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("first"))
    spans = starts.select("words", "first", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + WINDOW, F.size("words")) - 1)).alias("last"))
    ending = spans.where(F.get("words", F.col("last")).rlike(r"\d\d"))
    read = ending.select("words", "first", "last", period_a(F.array_join(F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + 1), " "))["label"].alias("label")).where("label is not null")
    found = read.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("first", "last", "label"))).alias("found"))
    kind = "array<struct<first:int,last:int,label:string>>"
    behind = lambda acc, w: F.coalesce(w["first"] > F.try_element_at(acc, F.lit(-1))["last"], F.lit(True))
    chosen = F.aggregate("found", F.array().cast(kind), lambda acc, w: F.when(behind(acc, w), F.concat(acc, F.array(w))).otherwise(acc))

    def tight(w: Column) -> Column:
        same = F.transform(F.filter("found", lambda u: (u["last"] == w["last"]) & (u["label"] == w["label"]) & (u["first"] >= w["first"])), lambda u: u["first"])
        unbroken = F.filter(same, lambda s: F.size(F.filter(same, lambda u: u <= s)) == s - w["first"] + 1)
        return F.struct(F.array_max(unbroken).alias("first"), w["last"].alias("last"), w["label"].alias("label"))

    spelt = found.select("words", F.transform(chosen, tight).alias("w"))
    return cell.join(spelt, "words").select(*by, F.explode("w").alias("w")).select(*by, "w.*")


def completed(columns: DataFrame, cells: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, page, line, x0, x1, label of "31, 2025" cells that lost their month to the line above.

    They take the month of the periods found on their line if all end on one month and day, theirs too, and the line above
    prints that month. columns: doc_id, page, line, end, x0, x1; cells: doc_id, page, line, text, x0, x1; above: doc_id, page, line, text.
    """
    on = [*PAGE, "line"]
    day = columns.groupBy(*on).agg(F.min(F.date_format("end", "MMdd")).alias("day"), F.max(F.date_format("end", "MMdd")).alias("other"), F.bool_and(F.col("end").isNotNull()).alias("whole"), F.collect_list(F.struct("x0", "x1")).alias("taken")).where("whole and day = other")
    name = F.element_at(F.array(*[F.lit(n.lower()) for n in calendar.month_name[1:]]), F.substring("day", 1, 2).cast("int"))
    months = day.join(above, on).withColumn("month", name).where(F.lower("text").contains(F.col("month"))).drop("text")
    parts = lambda k: F.regexp_extract(F.trim("text"), r"^(\d{1,2}),? (\d{4})$", k).try_cast("int")
    met = cells.withColumns({"day_said": parts(1), "year": parts(2)}).where("day_said is not null").join(months, on)
    middle = (F.col("x0") + F.col("x1")) / 2
    fresh = met.where((F.col("day_said") == F.substring("day", 3, 2).cast("int")) & ~F.exists("taken", lambda t: (middle >= t["x0"] - 1) & (middle <= t["x1"] + 1)))
    said = F.concat_ws(" ", "month", F.concat(F.col("day_said").cast("string"), F.lit(",")), F.col("year").cast("string"))
    return fresh.select(*on, "x0", "x1", period_a(said)["label"].alias("label"))


def column_basis(words: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, line, col, basis: what lines next to a header say of its columns.

    The two lines below and the one above count if all their words but one at most name a basis, the second below only if
    the first does; nearer lines come first. words: doc_id, page, line, x, text; columns: doc_id, page, line (the header's), col, x.
    """
    basis = F.regexp_extract(F.lower(F.trim("text")), rf"^\(?({'|'.join(BASES)})\)?$", 1)
    said = words.withColumn("basis", F.when(basis != "", basis))
    notes = said.groupBy(*PAGE, "line").agg(F.count("basis").alias("n"), F.count("*").alias("of")).where((F.col("n") > 0) & (F.col("n") >= F.col("of") - 1)).select(*PAGE, "line")
    heads = columns.select(*PAGE, F.col("line").alias("head")).distinct()
    near = heads.withColumn("way", F.explode(F.array(F.lit(1), F.lit(2), F.lit(-1)))).withColumn("line", F.col("head") + F.col("way")).join(notes, [*PAGE, "line"])
    first = near.where("way = 1").select(*PAGE, "head", F.lit(True).alias("first"))
    near = near.join(first, [*PAGE, "head"], "left").where("way <> 2 or first")
    marks = near.join(said.where("basis is not null"), [*PAGE, "line"]).select(*PAGE, "head", "way", "x", "basis")
    met = marks.join(columns.select(*PAGE, F.col("line").alias("head"), "col", F.col("x").alias("at")), [*PAGE, "head"])
    nearest = met.groupBy(*PAGE, "head", "way", "x", "basis").agg(F.min(F.struct(F.abs(F.col("x") - F.col("at")).alias("away"), "col")).alias("m"))
    order = F.when(F.col("way") > 0, F.col("way")).otherwise(3)
    return nearest.groupBy(*PAGE, F.col("head").alias("line"), F.col("m.col").alias("col")).agg(F.min_by("basis", F.struct(order, "x")).alias("basis"))


def nearest_dated(columns: DataFrame, most: int = 2) -> DataFrame:
    """doc_id, table_no, col, header: undated columns of figures and the dated header at most so many cells away, the right one on a tie (J26). columns: doc_id, table_no, col, header, dated, figures."""
    bare = columns.where("not dated and figures >= 2").select("doc_id", "table_no", F.col("col").alias("own"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("off")).withColumn("col", F.col("own") + F.col("off"))
    met = bare.join(columns.where("dated").select("doc_id", "table_no", "col", "header"), ["doc_id", "table_no", "col"])
    return met.groupBy("doc_id", "table_no", F.col("own").alias("col")).agg(F.min_by("header", F.struct(F.abs("off"), -F.col("off"))).alias("header"))


def borrowed_caption(tables: DataFrame, headers: DataFrame) -> DataFrame:
    """tables with caption, taken from the first header of the page where they have none (J29). tables: doc_id, page, table_no, caption; headers: doc_id, page, line, caption."""
    first = headers.groupBy(*PAGE).agg(F.min_by("caption", "line").alias("lent"))
    return tables.join(first, PAGE, "left").withColumn("caption", F.coalesce("caption", "lent")).drop("lent")


def prose_words(words: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, line, n: words of a line that are neither header vocabulary nor over one of its periods (P31). words: doc_id, page, line, x, text; columns: doc_id, page, line, x0, x1."""
    bare = F.regexp_replace(F.lower("text"), r"^[(),.:]+|[(),.:]+$", "")
    plain = words.where(F.col("text").rlike(r"\p{L}") & ~bare.isin(*VOCABULARY))
    over = columns.groupBy(*PAGE, "line").agg(F.collect_list(F.struct("x0", "x1")).alias("over"))
    free = plain.join(over, [*PAGE, "line"], "left").where(~F.coalesce(F.exists("over", lambda c: (F.col("x") >= c["x0"] - 1) & (F.col("x") <= c["x1"] + 1)), F.lit(False)))
    return free.groupBy(*PAGE, "line").agg(F.count("*").alias("n"))


def readable(chars: DataFrame, width: float, height: float) -> DataFrame:
    """Characters that a reader could see: of a point or more, and not outside the page (S11). chars: doc_id, page, x0, x1, top, bottom, size."""
    off = (F.col("x1") < -MARGIN) | (F.col("x0") > width + MARGIN) | (F.col("bottom") < -MARGIN) | (F.col("top") > height + MARGIN)
    return chars.where((F.col("size") >= VISIBLE) & ~off)


def invisible(chars: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page, n: white characters with no coloured box behind them (S11). chars: doc_id, page, x, y, is_white; boxes: doc_id, page, x0, x1, y0, y1."""
    return inside(chars.where("is_white"), boxes, outside=True).groupBy(*PAGE).agg(F.count("*").alias("n"))


def overlapping_spaces(chars: DataFrame, slice_width: float = 20.0) -> DataFrame:
    """Blanks printed inside a glyph of the same height, give or take a point (S12). chars: doc_id, page, no, x0, x1, top, is_blank. Glyphs and blanks meet by page, height and horizontal slice."""
    cut = lambda c: F.floor(c / slice_width)
    blanks = chars.where("is_blank").withColumn("mid", (F.col("x0") + F.col("x1")) / 2).withColumns({"height": F.round("top").cast("long"), "slice": cut(F.col("mid"))})
    glyphs = chars.where("not is_blank").select(*PAGE, F.col("x0").alias("g0"), F.col("x1").alias("g1"), F.round("top").cast("long").alias("own"), F.explode(F.sequence(cut(F.col("x0")), cut(F.col("x1")))).alias("slice"))
    glyphs = glyphs.withColumn("height", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    met = blanks.join(glyphs, [*PAGE, "height", "slice"]).where((F.col("mid") > F.col("g0") + 0.3) & (F.col("mid") < F.col("g1") - 0.3))
    return met.select(*PAGE, "no").distinct()
