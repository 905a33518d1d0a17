"""Tables of a page: ruled grids, cells that a box fused, the choice among tables that overlap, values in slots, and the scan of statements over page breaks.

Tables come as cells or as lines of a page; everything is a window, a join or an aggregate by table or page, so neither a
document nor a page is ever one task's whole business. Only the scan looks at a document's pages together, a row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods, units
from .layout import PAGE, islands, overlap

TABLE = [*PAGE, "table_no"]


def cleaned(text: str | Column) -> Column:
    """Runs of blanks and line ends as one blank, none at the ends; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\s+", " "))


def _joined(parts: Column, by: str = " ") -> Column:
    """The texts of an array of structs (order first, text last) in order."""
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), by)


# Ruled grids --------------------------------------------------------------------------------------------------------


def ruled(cells: DataFrame, head_rows: int = 4, least: int = 2) -> DataFrame:
    """doc_id, page, table_no, row, label, col, period, value, is_null_mark, unit: what a ruled grid says, by column index.

    The header is the first of a grid's first head_rows rows in which least cells or more are periods, no two of them the
    same; its unit is that of all text down to it. A row below counts if it has a value (or a mark for none) in a period's
    column and words in another. cells: doc_id, page, table_no, row, col, text; texts may be null or hold line ends.
    """
    by_row = Window.partitionBy(*TABLE).orderBy("row")
    read = cells.select(*TABLE, "row", "col", cleaned("text").alias("text")).withColumn("place", F.dense_rank().over(by_row))
    heads = read.where(F.col("place") <= head_rows).withColumn("period", F.when(F.col("text") != "", periods.period_a(F.col("text"))["label"]))
    heads = heads.groupBy(*TABLE, "row").agg(
        F.collect_list(F.when(F.col("period").isNotNull(), F.struct("col", "period"))).alias("found"), F.collect_list(F.when(F.col("text") != "", F.struct("col", "text"))).alias("texts"),
    )
    different = F.size(F.array_distinct(F.transform("found", lambda x: x["period"])))
    elected = (F.size("found") >= least) & (different == F.size("found"))
    grids = heads.groupBy(*TABLE).agg(
        F.min(F.when(elected, F.col("row"))).alias("header"), F.min_by(F.when(elected, F.map_from_entries("found")), F.when(elected, F.col("row"))).alias("columns"), F.collect_list(F.struct("row", _joined(F.col("texts")).alias("text"))).alias("above"),
    ).where("header is not null")
    said = _joined(F.filter("above", lambda x: x["row"] <= F.col("header")))
    grids = grids.select(*TABLE, "header", "columns", units.unit_a(said).alias("unit"))
    below = read.where("text <> ''").join(grids, TABLE).where(F.col("row") > F.col("header")).withColumn("period", F.try_element_at("columns", F.col("col"))).withColumn("n", numbers.value_a(F.col("text")))
    figure = F.col("period").isNotNull() & (F.col("n.value").isNotNull() | F.col("n.is_null_mark"))
    words = F.col("period").isNull() & F.col("n.value").isNull()
    label = _joined(F.collect_list(F.when(words, F.struct("col", "text"))).over(Window.partitionBy(*TABLE, "row")))
    return below.withColumn("figure", figure).withColumn("label", label).where("figure and label <> ''").select(*TABLE, "row", "label", "unit", "col", "period", "n.value", "n.is_null_mark")


def header_info(cells: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, page, table_no, n_header, col, header: the leading rows without an amount beside the first column, at most so many, and each column's text in them from the top down (F21). A table that has none, or nothing else, has no row."""
    read = cells.select(*TABLE, "row", "col", cleaned("text").alias("text")).where("text <> ''").withColumn("place", F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("row")))
    amount = (F.col("col") > 0) & numbers.parse_b(F.col("text")).isNotNull() & ~_is_year(F.col("text"))
    marked = read.withColumns({"first": F.min(F.when(amount, F.col("place"))).over(Window.partitionBy(*TABLE)), "rows": F.max("place").over(Window.partitionBy(*TABLE))})
    n = F.least(F.coalesce(F.col("first") - 1, F.col("rows")), F.lit(most))
    heads = marked.withColumn("n_header", n).where((F.col("n_header") > 0) & (F.col("n_header") < F.col("rows")) & (F.col("place") <= F.col("n_header")))
    return heads.groupBy(*TABLE, "n_header", "col").agg(_joined(F.collect_list(F.struct("row", "text"))).alias("header"))


def turned(cells: DataFrame, most_head: float = 0.3, least_side: float = 0.6) -> DataFrame:
    """cells with rows and columns changed where periods run down the first column and not over the first row (F21); tables of fewer than three rows or columns stay. Empty rows don't count; the others are numbered anew."""
    read = cells.select(*TABLE, "row", "col", cleaned("text").alias("text"))
    # Cells of a row are peers in a window over the table, so one shuffle and one sort serve rows and tables.
    by_row = Window.partitionBy(*TABLE).orderBy("row")
    some = read.withColumn("some", F.bool_or(F.col("text") != "").over(by_row.rangeBetween(0, 0))).where("some").withColumn("row", F.dense_rank().over(by_row) - 1)
    whole = Window.partitionBy(*TABLE)
    at_side, at_head = (F.col("col") == 0) & (F.col("row") > 0) & (F.col("text") != ""), (F.col("row") == 0) & (F.col("col") > 0) & (F.col("text") != "")
    is_period = F.when(at_side | at_head, periods.period_b(F.col("text")).isNotNull().cast("int"))
    share = lambda where: F.avg(F.when(where, F.col("is_period"))).over(whole)
    facts = some.withColumn("is_period", is_period).withColumns({"side": share(at_side), "head": share(at_head), "rows": F.max("row").over(whole) + 1, "wide": F.max(F.when(F.col("row") == 0, F.col("col"))).over(whole) + 1})
    flip = F.coalesce((F.col("side") >= least_side) & (F.col("head") <= most_head) & (F.col("rows") >= 3) & (F.col("wide") >= 3), F.lit(False))
    return facts.select(*TABLE, F.when(flip, F.col("col")).otherwise(F.col("row")).alias("row"), F.when(flip, F.col("row")).otherwise(F.col("col")).alias("col"), "text", flip.alias("turned"))


# Cells that a box fused ---------------------------------------------------------------------------------------------


def _is_year(text: Column) -> Column:
    return text.rlike(r"^(?:19|20)\d\d$")


def _is_amount(token: Column) -> Column:
    """Is one word of a cell an amount? Whole numbers of one or two digits and bare years are none."""
    shaped = (token.contains(",") | token.contains(".") | (F.length(token) >= 3)) & ~_is_year(token)
    return F.when(shaped, numbers.parse_b(token).isNotNull()).otherwise(False)


def _amounts_in(text: Column) -> Column:
    """How many words of a cell's cleaned text are amounts."""
    return F.size(F.filter(F.split(text, " "), _is_amount))


def fused(cells: DataFrame) -> DataFrame:
    """Tables of which one cell holds three amounts or more, or two cells two: boxes without lines between their rows."""
    found = cells.select(*TABLE, _amounts_in(cleaned("text")).alias("n")).groupBy(*TABLE).agg(F.max("n").alias("most"), F.count_if(F.col("n") >= 2).alias("twos"))
    return found.where("most >= 3 or twos >= 2").select(*TABLE)


def recut(cells: DataFrame, words: DataFrame, slice_height: float = 100.0, most_gap: float = 0.5) -> DataFrame:
    """doc_id, page, table_no, row, col, text of fused tables, cut anew (S10): the words inside a table's box, each in the interval between two of the grid's lines that holds most of it (the left one on ties), and in a line with those whose middle lies within most_gap of a word's height from the next.

    cells: doc_id, page, table_no, row, col, x0, x1, y0, y1, text; words: doc_id, page, no, x0, x1, y0, y1, text.
    """
    of_fused = cells.join(fused(cells), TABLE, "left_semi")
    boxes = of_fused.groupBy(*TABLE).agg(F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y0").alias("by0"), F.max("y1").alias("by1"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("x0", "x1"))))).alias("lines"))
    cut = lambda c: F.floor(c / slice_height)
    held = boxes.withColumn("slice", F.explode(F.sequence(cut(F.col("by0")), cut(F.col("by1")))))
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = words.withColumns({"mid": mid_y, "slice": cut(mid_y)}).join(held, [*PAGE, "slice"]).where(mid_x.between(F.col("bx0"), F.col("bx1")) & F.col("mid").between(F.col("by0"), F.col("by1")))
    # Intervals of a row of the grid: as many as it has lines, less one.
    spans = F.transform(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: F.struct(overlap(F.col("x0"), F.col("x1"), F.element_at("lines", i), F.element_at("lines", i + 1)).alias("shared"), (-i).alias("back")))
    placed = inside.withColumn("col", -F.array_max(spans)["back"] - 1)
    above = F.lag("mid").over(Window.partitionBy(*TABLE).orderBy("mid", "no"))
    rows = islands(placed.withColumn("gap", F.col("mid") - above).withColumn("order", F.struct("mid", "no")), TABLE, "order", F.col("gap").isNull() | (F.col("gap") > most_gap * (F.col("y1") - F.col("y0"))), "row")
    return rows.groupBy(*TABLE, "row", "col").agg(_joined(F.collect_list(F.struct("x0", "no", "text"))).alias("text"))


# The choice among tables of a page ----------------------------------------------------------------------------------


def facts(cells: DataFrame) -> DataFrame:
    """doc_id, page, table_no, n_rows, n_cols, n_amounts, density, labelless (P31): amounts over all cells, the share of filled cells that are one, and whether no cell of the first column holds a word."""
    read = cells.select(*TABLE, "row", "col", cleaned("text").alias("text"))
    filled, one_word = F.col("text") != "", ~F.col("text").contains(" ")
    # A cell of one word is read once: the word's amount is the cell's, but for the short and the years.
    whole = F.when(filled, numbers.parse_b(F.col("text")).isNotNull()).otherwise(False)
    short = ~(F.col("text").contains(",") | F.col("text").contains(".") | (F.length("text") >= 3)) | _is_year(F.col("text"))
    judged = read.withColumn("is_amount", whole).withColumn("n", F.when(one_word, (F.col("is_amount") & ~short).cast("int")).otherwise(_amounts_in(F.col("text"))))
    # Rows of a grid first, all their figures of fixed size, then grids: neither sorts cells.
    rows = judged.groupBy(*TABLE, "row").agg(
        F.max("col").alias("last"), F.sum("n").alias("n"), F.count_if(filled).alias("filled"), F.count_if(filled & F.col("is_amount")).alias("amounts"), F.bool_or((F.col("col") == 0) & F.col("text").rlike("[A-Za-z]{2}")).alias("worded"),
    )
    return rows.groupBy(*TABLE).agg(
        F.count_if(F.col("filled") > 0).alias("n_rows"), (F.max("last") + 1).alias("n_cols"), F.sum("n").alias("n_amounts"), F.coalesce(F.try_divide(F.sum("amounts").cast("double"), F.sum("filled").cast("double")), F.lit(0.0)).alias("density"),
        (~F.bool_or("worded")).alias("labelless"),
    )


def preferred(tables: DataFrame, least_density: float = 0.2, most_band: int = 6, most_gap: float = 30.0, slice_height: float = 100.0) -> DataFrame:
    """tables with kept and reason (J14, P31). tables: doc_id, page, table_no, strategy ('lines', 'statement' or 'text'), x0, x1, y0, y1, n_rows, n_amounts, density, labelless.

    A statement stays. A ruled box of few rows and no amount is a band, and goes where a statement has taken it in (half of
    it or more) or begins right below. A ruled box without labels goes where a statement covers it (over half of the lower
    of both). Tables found by blanks stay if amounts fill enough cells, nothing ruled is left on the page, and no
    statement covers them.
    """
    band = (F.col("strategy") == "lines") & (F.col("n_rows") <= most_band) & (F.col("n_amounts") == 0)
    known = tables.withColumn("band", band)
    cut = lambda c: F.floor(c / slice_height)
    spread = lambda rows, below: rows.withColumn("slice", F.explode(F.sequence(cut(F.col("y0")), cut(F.col("y1") + below))))
    mine = spread(known.where("strategy <> 'statement'"), most_gap).select(*TABLE, "slice", "x0", "x1", "y0", "y1")
    theirs = spread(known.where("strategy = 'statement'"), 0.0).select(*PAGE, "slice", *[F.col(c).alias(f"s_{c}") for c in ("x0", "x1", "y0", "y1")])
    met = mine.join(theirs, [*PAGE, "slice"])
    shared, gap = overlap(F.col("y0"), F.col("y1"), F.col("s_y0"), F.col("s_y1")), F.col("s_y0") - F.col("y1")
    lower = F.least(F.col("y1") - F.col("y0"), F.col("s_y1") - F.col("s_y0"))
    beside = overlap(F.col("x0"), F.col("x1"), F.col("s_x0"), F.col("s_x1")) > 0
    feeds = beside & ((shared >= 0.5 * (F.col("y1") - F.col("y0"))) | gap.between(-2.0, most_gap))
    told = met.groupBy(*TABLE).agg(F.bool_or((shared > 0) & (shared > 0.5 * lower)).alias("covered"), F.bool_or(feeds).alias("feeds"))
    judged = known.join(told, TABLE, "left").fillna(False, ["covered", "feeds"])
    gone = F.col("band") & F.col("feeds") | ((F.col("strategy") == "lines") & ~F.col("band") & F.col("labelless") & F.col("covered"))
    left = F.bool_or((F.col("strategy") == "lines") & (F.col("band") | ~gone)).over(Window.partitionBy(*PAGE))
    by_blanks = F.when(F.col("density") < least_density, "prose").when(left, "ruled page").when(F.col("covered"), "covered")
    reason = F.when(F.col("strategy") == "text", by_blanks).when(F.col("band") & F.col("feeds"), "band of a statement").when(gone, "box without labels")
    return judged.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull()).drop("band", "covered", "feeds")


# Values in slots ----------------------------------------------------------------------------------------------------


def _away(anchors: Column, x: Column) -> Column:
    return F.transform(anchors, lambda a: F.abs(a - x))


def placed_values(values: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, table_no, row, no, slot (W23): a row's values one to a slot. values: doc_id, table_no, row, no, x1; columns: doc_id, table_no, n_cols, anchors (right edges of the columns, rising).

    Where a table has an anchor for each column, a value goes to the nearest (the left one on ties); if two meet, the row is
    right-aligned by order. Otherwise values fill slots from the left. A row of more values than columns has no row here.
    """
    rows = values.groupBy("doc_id", "table_no", "row").agg(F.array_sort(F.collect_list(F.struct("x1", "no"))).alias("v"))
    met = rows.join(columns, ["doc_id", "table_no"]).withColumn("k", F.size("v")).where("k <= n_cols")
    nearest = F.transform("v", lambda x: (F.array_position(_away(F.col("anchors"), x["x1"]), F.array_min(_away(F.col("anchors"), x["x1"]))) - 1).cast("int"))
    met = met.withColumn("near", F.when(F.size("anchors") == F.col("n_cols"), nearest))
    clash = F.size(F.array_distinct("near")) < F.col("k")
    first = F.when(clash, F.col("n_cols") - F.col("k")).otherwise(F.lit(0))
    in_order = F.sequence(first, first + F.col("k") - 1)
    slots = F.when(F.col("near").isNull() | clash, in_order).otherwise(F.col("near"))
    told = met.select("doc_id", "table_no", "row", F.explode(F.arrays_zip(F.col("v.no").alias("no"), slots.alias("slot"))).alias("x"))
    return told.select("doc_id", "table_no", "row", "x.no", "x.slot")


def promoted_rows(tokens: DataFrame, columns: DataFrame, chain: float = 10.0) -> DataFrame:
    """doc_id, table_no, line, n: lines within a statement that count as rows after all (W23): the values that end a line all lie within one and a half times chain of a column's right edge, and aren't all years. tokens: doc_id, table_no, line, no (in order), x1, text, is_value, is_row (the line counts already); columns: doc_id, table_no, anchors."""
    lines = tokens.where("not is_row").groupBy("doc_id", "table_no", "line").agg(F.max(F.when(~F.col("is_value"), F.col("no"))).alias("last_word"), F.collect_list(F.when(F.col("is_value"), F.struct("no", "x1", _is_year(F.col("text")).alias("year")))).alias("v"))
    tail = lines.select("doc_id", "table_no", "line", F.filter("v", lambda x: F.col("last_word").isNull() | (x["no"] > F.col("last_word"))).alias("v"))
    met = tail.where(F.size("v") > 0).join(columns.select("doc_id", "table_no", "anchors"), ["doc_id", "table_no"])
    on_column = F.forall("v", lambda x: F.coalesce(F.array_min(_away(F.col("anchors"), x["x1"])) <= 1.5 * chain, F.lit(False)))
    return met.where(on_column & ~F.forall("v", lambda x: x["year"])).select("doc_id", "table_no", "line", F.size("v").alias("n"))


# The scan of statements over page breaks ----------------------------------------------------------------------------


def _scanned(lines: DataFrame, most_blank: int) -> DataFrame:
    """lines (of a page's segment, with the columns k that hold there) with accepted and the whole label. A segment ends after most_blank lines without figures."""
    figures = F.col("n_figures")
    # A header, a row, and figures that don't fit all end a run of lines without figures.
    marked = lines.withColumn("reset", F.col("n_cols").isNotNull() | (figures > 0)).withColumn("blank", F.col("n_cols").isNull() & (figures == 0))
    # Runs are numbered down a page, so order by run and line is that by line, and one sort serves segments and runs.
    marked = marked.withColumn("run", F.sum(F.col("reset").cast("int")).over(Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    segment = Window.partitionBy(*PAGE, "segment").orderBy("run", "line")
    so_far = segment.rowsBetween(Window.unboundedPreceding, 0)
    in_run = F.sum(F.col("blank").cast("int")).over(Window.partitionBy(*PAGE, "segment", "run").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("n_blank", in_run)
    marked = marked.withColumn("ended", F.bool_or(F.col("n_blank") > most_blank).over(so_far)).withColumn("label", cleaned("label"))
    before = F.collect_list(F.when(F.col("blank") & (F.col("label") != ""), F.struct("line", "run", F.col("label").alias("text")))).over(segment.rowsBetween(-most_blank, -1))
    waiting = F.array_join(F.transform(F.filter(F.array_sort(before), lambda x: x["run"] == F.col("run") - 1), lambda x: x["text"]), " ")
    goes_on = (waiting != "") & ((F.length("label") < 3) | F.col("label").rlike(r"^\p{Ll}"))
    whole = F.when(goes_on, F.trim(F.concat_ws(" ", waiting, F.col("label")))).otherwise(F.col("label"))
    accepted = F.col("n_cols").isNull() & (figures > 0) & (figures <= F.col("k")) & ~F.col("ended")
    return marked.withColumn("whole_label", whole).withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def scan(lines: DataFrame, most_blank: int = 6, low: float = 0.7, most_above: int = 8) -> DataFrame:
    """doc_id, page, line, label, n_figures, n_cols, unit, table_page, table_segment: rows of statements, and the table (by the page and segment where it begins) to which they belong.

    A header line begins a table. Lines of figures, no more than its columns, are its rows; labels without figures wait for
    the next row, and are put before its label if that is short or begins in lower case; after most_blank lines without
    figures the table ends. If the last row of a page's last table lies lower than low, the table goes on over the next
    page: lines before the first header there are rows of it, and a header of the same columns among the first most_above
    lines continues it; unit and columns are carried. lines: doc_id, page, line, top (share of the page's height), label,
    n_figures, and for headers n_cols and columns (their wording), else null; unit or null.

    Each page is folded for itself, given the columns that the last page with a table of its own hands down; what a page
    passes on is a row, and a window over a document's pages tells where the chain breaks.
    """
    on_page = Window.partitionBy(*PAGE).orderBy("line")
    so_far = on_page.rowsBetween(Window.unboundedPreceding, 0)
    read = lines.withColumns({"segment": F.count("n_cols").over(so_far), "place": F.row_number().over(on_page), "n_figures": F.coalesce("n_figures", F.lit(0))})
    read = read.withColumn("head", F.last(F.when(F.col("n_cols").isNotNull(), F.struct("n_cols", "columns", "unit", "place")), ignorenulls=True).over(so_far))
    of_head = {"k": F.col("head.n_cols"), "heading": F.col("head.columns"), "head_place": F.col("head.place"), "head_unit": F.col("head.unit")}
    own = _scanned(read.where("segment > 0").withColumns(of_head), most_blank).where("accepted")
    own_tables = own.groupBy(*PAGE, "segment").agg(F.max_by("top", "line").alias("bottom"), F.first("k").alias("k"), F.first("heading").alias("heading"), F.first("head_place").alias("head_place"), F.first("head_unit").alias("unit"))
    last_own = own_tables.groupBy(*PAGE).agg(F.max(F.struct("segment", "bottom", "k", "heading", "unit")).alias("own"))
    pages = lines.groupBy(*PAGE).agg(F.count("*").alias("n")).drop("n").join(last_own, PAGE, "left")

    by_page = Window.partitionBy("doc_id").orderBy("page")
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("source", F.last(F.when(F.col("own").isNotNull(), F.struct("page", "own.segment", "own.k", "own.heading")), ignorenulls=True).over(before))
    handed = pages.where("source is not null").select(*PAGE, F.col("source.k").alias("k"))
    onward = _scanned(read.where("segment = 0").join(handed, PAGE), most_blank).where("accepted")
    first = onward.groupBy(*PAGE).agg(F.max_by("top", "line").alias("first_bottom"))
    pages = pages.join(first, PAGE, "left")
    reached = F.coalesce(F.coalesce(F.col("own.bottom"), F.col("first_bottom")) > low, F.lit(False))
    linked = F.coalesce((F.col("page") == F.lag("page").over(by_page) + 1) & F.lag(reached).over(by_page), F.lit(False))
    pages = pages.withColumns({"linked": linked, "run": F.count(F.when(F.col("own").isNotNull(), 1)).over(before)})
    since = Window.partitionBy("doc_id", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("alive", F.col("source").isNotNull() & F.bool_and("linked").over(since))

    # What the last table of each page is: one carried on, or one of its own.
    told = own_tables.join(pages.select(*PAGE, "alive", F.col("source.heading").alias("carried")), PAGE)
    told = told.withColumn("continued", F.col("alive") & (F.col("heading") == F.col("carried")) & (F.col("head_place") <= most_above))
    last = told.groupBy(*PAGE).agg(F.max_by("continued", "segment").alias("continued"))
    pages = pages.join(last, PAGE, "left")
    begins = F.when(F.col("own").isNotNull() & ~F.col("continued"), F.struct("page", "own.segment"))
    pages = pages.withColumn("table", F.last(begins, ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("doc_id", "table").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("unit", F.last("own.unit", ignorenulls=True).over(chain))
    carry = pages.withColumns({"from_table": F.lag("table").over(by_page), "from_unit": F.lag("unit").over(by_page)}).where("alive").select(*PAGE, "from_table", "from_unit")
    tables = told.join(carry, PAGE, "left").select(
        *PAGE, "segment", F.when(F.col("continued"), F.col("from_table")).otherwise(F.struct("page", "segment")).alias("table"), F.coalesce("unit", F.when(F.col("continued"), F.col("from_unit"))).alias("of_unit"),
    )
    rows = own.join(tables, [*PAGE, "segment"]).unionByName(onward.join(carry.withColumnsRenamed({"from_table": "table", "from_unit": "of_unit"}), PAGE), allowMissingColumns=True)
    return rows.select(*PAGE, "line", F.col("whole_label").alias("label"), "n_figures", F.col("k").alias("n_cols"), F.col("of_unit").alias("unit"), F.col("table.page").alias("table_page"), F.col("table.segment").alias("table_segment"))


# What a page lends to its grids --------------------------------------------------------------------------------------


def context(lines: DataFrame, for_unit: int = 10, for_basis: int = 14, titles: int = 3, head: int = 12, for_rules: int = 40) -> DataFrame:
    """doc_id, page, line, unit, unit_source, basis, title, eligible of each header line (J29). lines: doc_id, page, line, text, is_header, names_rules (the line speaks of eligibility).

    The unit is the header's own, or that of the nearest of for_unit lines above, or the first among the page's head lines. The
    basis is that of the nearest of for_basis lines above which names one of the two, or that of the head lines if they name
    just one. The title is the last lines above that aren't blank. All from one window over a page's lines.
    """
    by = Window.partitionBy(*PAGE).orderBy("line")
    back = lambda n: by.rowsBetween(-n, -1)
    page = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.lower("text")
    both, alone = low.contains("consolidated"), low.contains("standalone")
    basis = lambda c, s: F.when(c & ~s, "consolidated").when(s & ~c, "standalone")
    read = lines.withColumns({"text": cleaned("text"), "place": F.row_number().over(by)}).withColumns({"u": units.unit_a(F.col("text")), "b": basis(both, alone)})
    top = F.col("place") <= head
    told = read.withColumns({
        "caption": F.last("u", ignorenulls=True).over(back(for_unit)), "heading": F.first(F.when(top, F.col("u")), ignorenulls=True).over(page), "near": F.last("b", ignorenulls=True).over(back(for_basis)),
        "of_head": basis(F.bool_or(top & both).over(page), F.bool_or(top & alone).over(page)), "above": F.collect_list(F.when(F.col("text") != "", F.col("text"))).over(back(for_basis)), "eligible": F.coalesce(F.bool_or("names_rules").over(back(for_rules)), F.lit(False)),
    }).where("is_header")
    source = F.when(F.col("u").isNotNull(), "header").when(F.col("caption").isNotNull(), "caption").when(F.col("heading").isNotNull(), "page_heading")
    title = F.substring(F.array_join(F.slice("above", F.greatest(F.size("above") - titles + 1, F.lit(1)), titles), " / "), 1, 300)
    return told.select(*PAGE, "line", F.coalesce("u", "caption", "heading").alias("unit"), source.alias("unit_source"), F.coalesce("near", "of_head").alias("basis"), title.alias("title"), "eligible")


def lent(grids: DataFrame, lines: DataFrame) -> DataFrame:
    """grids (doc_id, page, table_no, unit) with unit, unit_source, basis, title and eligible: what is missing comes from the first header line of the page."""
    first = context(lines).groupBy(*PAGE).agg(F.min_by(F.struct("unit", "unit_source", "basis", "title", "eligible"), "line").alias("lent"))
    met = grids.withColumnRenamed("unit", "own").join(first, PAGE, "left")
    source = F.when(F.col("own").isNotNull(), "header").otherwise(F.col("lent.unit_source"))
    return met.select(*[c for c in grids.columns if c != "unit"], F.coalesce("own", "lent.unit").alias("unit"), source.alias("unit_source"), "lent.basis", "lent.title", F.coalesce("lent.eligible", F.lit(False)).alias("eligible"))
