"""From words on a page to lines, cells, columns and tables.

Everything joins or windows on (doc_id, page) first; only running means and carried state fold in Python, a page (or a
document's few hundred pages) at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import WindowSpec

PAGE = ["doc_id", "page"]


def numbered(words: DataFrame, order: list[Column], at: Column, within: Callable[[WindowSpec], Column], running: bool) -> DataFrame:
    """words with line: from the top down in order, a word joins a line if at lies within of that of the line's first word or, if running, of the mean of its words so far.

    A page is a stretch of a sorted partition, streamed in batches of Arrow: no page is held whole, and none costs a call of its own.
    """
    by = Window.partitionBy(*PAGE).orderBy(*[F.col(f"_order{i}").asc_nulls_last() for i in range(len(order))])
    keyed = words.withColumns({f"_order{i}": c for i, c in enumerate(order)} | {"_at": at})
    marked = keyed.withColumns({"_first": F.row_number().over(by) == 1, "_within": within(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ordered = marked.sortWithinPartitions(*PAGE, *[F.col(f"_order{i}").asc_nulls_last() for i in range(len(order))])
    names = words.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, middle, n = 0, 0.0, 0
        for batch in batches:
            out = []
            for first, x, reach in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("_first", "_at", "_within")), strict=True):
                if first or abs(x - middle) > reach:
                    line, middle, n = 1 if first else line + 1, x, 1
                elif running:
                    n += 1
                    middle += (x - middle) / n
                out.append(line)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "line"])

    return ordered.select(*names, "_first", "_at", "_within").mapInArrow(number, StructType([*words.schema.fields, StructField("line", LongType())]))


def _half_height(page: WindowSpec) -> Column:
    return F.greatest(F.lit(1e-9), F.percentile(F.col("bottom") - F.col("top"), 0.5).over(page) / 2)


def lines(words: DataFrame) -> DataFrame:
    """words with line: from the top down, a word joins a line if its middle lies within half a height (the page's median) of the line's running mean. words: doc_id, page, word_no, top, bottom, x0, x1, text."""
    mid = (F.col("top") + F.col("bottom")) / 2
    return numbered(words, [mid, F.col("x0"), F.col("word_no")], mid.cast("double"), _half_height, True)


def islands(rows: DataFrame, by: list[str], order: str, start: Column, name: str) -> DataFrame:
    """rows with a number that goes up wherever start holds."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.coalesce(start, F.lit(True)).cast("int")).over(over))


def cells(words: DataFrame, wide: float = 2.2) -> DataFrame:
    """words with cell: a new one after a gap of over wide blanks (a blank: the median glyph width of the page). words: ..., line, x0, x1, text."""
    space = F.percentile((F.col("x1") - F.col("x0")) / F.greatest(F.length("text"), F.lit(1)), 0.5).over(Window.partitionBy(*PAGE))
    before = F.lag("x1").over(Window.partitionBy(*PAGE, "line").orderBy("x0"))
    marked = words.withColumns({"space": space, "gap": F.col("x0") - before})
    return islands(marked, [*PAGE, "line"], "x0", F.col("gap").isNull() | (F.col("gap") > wide * F.col("space")), "cell").drop("gap", "space")


def anchors(numbers: DataFrame, chain: float = 10.0) -> DataFrame:
    """Columns of right edges: sorted edges chain while the gap is small; the median of a chain is its place. numbers: doc_id, page, x1."""
    before = F.lag("x1").over(Window.partitionBy(*PAGE).orderBy("x1"))
    chained = islands(numbers.withColumn("gap", F.col("x1") - before), PAGE, "x1", F.col("gap").isNull() | (F.col("gap") > chain), "anchor")
    return chained.groupBy(*PAGE, "anchor").agg(F.percentile("x1", 0.5).alias("at"), F.count("*").alias("n"))


def blocks(text_lines: DataFrame, most: float = 0.9) -> DataFrame:
    """lines with block: a new one where the gap above passes most times the line's height. text_lines: doc_id, page, line, top, bottom."""
    above = F.lag("bottom").over(Window.partitionBy(*PAGE).orderBy("line"))
    tall = text_lines.withColumn("gap", F.col("top") - above)
    return islands(tall, PAGE, "line", F.col("gap").isNull() | (F.col("gap") > most * (F.col("bottom") - F.col("top"))), "block").drop("gap")


def segments(rows: DataFrame, most_between: int = 3, least: int = 3, most_heights: float = 6.0) -> DataFrame:
    """Runs of data lines with at most so many others between and, where tops and bottoms are given, no gap of over most_heights times a line's height; runs of fewer than least are no statement (W12). rows: doc_id, page, line, is_data, and top and bottom if known."""
    data = rows.where("is_data")
    by = Window.partitionBy(*PAGE).orderBy("line")
    apart = F.col("skip").isNull() | (F.col("skip") > most_between)
    if "top" in rows.columns:
        apart = apart | (F.col("top") - F.lag("bottom").over(by) > most_heights * (F.col("bottom") - F.col("top")))
    marked = data.withColumn("skip", F.col("line") - F.lag("line").over(by) - 1).withColumn("apart", apart)
    run = islands(marked, PAGE, "line", F.col("apart"), "segment")
    return run.groupBy(*PAGE, "segment").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n")).where(F.col("n") >= least)


def nearest_column(numbers: DataFrame, columns: DataFrame, share: float = 0.6, least: float = 12.0) -> DataFrame:
    """Each number and the nearest column of its page, if within share of the columns' spacing (least at least). numbers: doc_id, page, no, x; columns: doc_id, page, col, at."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(*PAGE).orderBy("at"))
    spacing = columns.withColumn("gap", gap).groupBy(*PAGE).agg(F.min("gap").alias("spacing"))
    met = numbers.join(columns, PAGE).withColumn("away", F.abs(F.col("x") - F.col("at")))
    best = met.groupBy(*PAGE, "no").agg(F.min(F.struct("away", "col")).alias("m")).join(spacing, PAGE)
    reach = F.greatest(F.lit(least), F.coalesce(F.col("spacing") * share, F.lit(least)))
    return best.where(F.col("m.away") <= reach).select(*PAGE, "no", "m.col", "m.away")


def banded(numbers: DataFrame, columns: DataFrame) -> DataFrame:
    """Each number and the column whose band (its left edge to the next one's) holds it; an as-of join by union and window, no theta join. numbers: doc_id, page, no, x; columns: doc_id, page, col, x."""
    kind = dict(columns.dtypes)["col"]
    edges = columns.select(*PAGE, "x", F.lit(0).alias("side"), "col", F.lit(None).cast(dict(numbers.dtypes)["no"]).alias("no"))
    marks = numbers.select(*PAGE, "x", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("col"), "no")
    last = F.last("col", ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("x", "side", "no"))
    return edges.unionByName(marks).withColumn("band", last).where("side = 1").select(*PAGE, "no", F.col("band").alias("col"))


def inside(points: DataFrame, boxes: DataFrame, outside: bool = False, slice_height: float = 100.0) -> DataFrame:
    """Points of a page that some box holds (or none). Boxes and points meet by page and horizontal slice, so a page full of both stays small. points: doc_id, page, x, y; boxes: doc_id, page, x0, x1, y0, y1."""
    cut = lambda c: F.floor(c / slice_height)
    held = boxes.select(F.col("doc_id").alias("bd"), F.col("page").alias("bp"), "x0", "x1", "y0", "y1", F.explode(F.sequence(cut(F.col("y0")), cut(F.col("y1")))).alias("bs"))
    on = (F.col("doc_id") == F.col("bd")) & (F.col("page") == F.col("bp")) & (cut(F.col("y")) == F.col("bs")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return points.join(held, on, "left_anti" if outside else "left_semi")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlapping(left: DataFrame, right: DataFrame, least: float = 0.5, slice_height: float = 100.0) -> DataFrame:
    """doc_id, page, no, box: rows of left and right whose heights overlap by least of the lower one or more (J14). They meet by page and slice. left: doc_id, page, no, y0, y1; right: doc_id, page, box, y0, y1."""
    cut = lambda c: F.floor(c / slice_height)
    spread = lambda rows, name: rows.select(*PAGE, name, F.col("y0").alias(f"{name}_0"), F.col("y1").alias(f"{name}_1"), F.explode(F.sequence(cut(F.col("y0")), cut(F.col("y1")))).alias("slice"))
    met = spread(left, "no").join(spread(right, "box"), [*PAGE, "slice"])
    shared = overlap(F.col("no_0"), F.col("no_1"), F.col("box_0"), F.col("box_1"))
    lower = F.least(F.col("no_1") - F.col("no_0"), F.col("box_1") - F.col("box_0"))
    return met.where((shared > 0) & (shared >= least * lower)).select(*PAGE, "no", "box").distinct()


def carried(rows: DataFrame, by: list[str], order: str, column: str, back: int) -> DataFrame:
    """rows with the last value of column among the back rows before (captions, units, basis above a table)."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-back, -1)
    return rows.withColumn(f"{column}_above", F.last(column, ignorenulls=True).over(frame))


def carried_or_head(rows: DataFrame, by: list[str], order: str, column: str, back: int, head: int = 12) -> DataFrame:
    """As carried, and where those rows hold nothing, the last value among the first head rows of the page, as far as they lie above."""
    near = carried(rows, by, order, column, back)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    above = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.last(F.when(F.col("place") <= head, F.col(column)), ignorenulls=True).over(above)
    return near.withColumn("place", place).withColumn(f"{column}_above", F.coalesce(f"{column}_above", top)).drop("place")


def any_above(rows: DataFrame, by: list[str], order: str, hit: Column, back: int = 40) -> DataFrame:
    """rows with whether any of the back rows before has a hit."""
    return rows.withColumn("any_above", F.coalesce(F.bool_or(hit).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-back, -1)), F.lit(False)))


def stitched(tables: DataFrame) -> DataFrame:
    """tables with whole: a number that tables share which run on over a page break: next page, bottom at 80 % or lower, top at 25 % or higher, same width, same header or none, same unit or none on either side (W18). tables: doc_id, page, top, bottom, width, header, unit."""
    by = Window.partitionBy("doc_id").orderBy("page", "top")
    was = lambda c: F.lag(c).over(by)
    goes_on = (F.col("page") == was("page") + 1) & (was("bottom") >= 0.8) & (F.col("top") <= 0.25) & (F.col("width") == was("width")) & (F.col("header").isNull() | F.col("header").eqNullSafe(was("header"))) & F.coalesce(F.col("unit") == was("unit"), F.lit(True))
    marked = tables.withColumn("new", ~F.coalesce(goes_on, F.lit(False)))
    return marked.withColumn("whole", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def inherited(tables: DataFrame, column: str, most_pages: int = 2, same: tuple[str, ...] = ("anchors",)) -> DataFrame:
    """tables with column filled from the nearest earlier table of the document with the same shape and at most so many pages before; rows filled by it may pass it on.

    Tables of one shape in order make runs: a new one begins with a value of its own, or after more pages than that.
    """
    by = Window.partitionBy("doc_id", *same).orderBy("page", "table_no")
    begins = F.col(column).isNotNull() | F.coalesce(F.col("page") - F.lag("page").over(by) > most_pages, F.lit(True))
    runs = tables.withColumn("begins", begins).withColumn("run", F.sum(F.col("begins").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    filled = F.first(column).over(Window.partitionBy("doc_id", *same, "run").orderBy("page", "table_no"))
    return runs.withColumn(column, filled).select(*tables.columns)


def unit_donors(tables: DataFrame, most_pages: int = 2) -> DataFrame:
    """Tables without a unit and the one unit of tables of the same dates at most so many pages before, if they agree; of those as near behind where none is before (J16). tables: doc_id, table_no (in order), page, unit, dates."""
    same = Window.partitionBy("doc_id", "dates")
    # Other pages by their distance, tables of the page itself by their number; one sort serves all four frames.
    near = {"before": same.orderBy("page").rangeBetween(-most_pages, -1), "after": same.orderBy("page").rangeBetween(1, most_pages)}
    here = Window.partitionBy("doc_id", "dates", "page").orderBy("table_no")
    here = {"before": here.rangeBetween(Window.unboundedPreceding, -1), "after": here.rangeBetween(1, Window.unboundedFollowing)}
    picks = {"least": (F.min, F.least), "most": (F.max, F.greatest)}
    of_page = tables.dropna(subset=["doc_id", "dates", "page", "table_no"]).withColumns({f"{side}_{k}_here": f("unit").over(frame) for side, frame in here.items() for k, (f, _) in picks.items()})
    told = of_page.withColumns({f"{side}_{k}": both(F.col(f"{side}_{k}_here"), f("unit").over(frame)) for side, frame in near.items() for k, (f, both) in picks.items()}).where("unit is null")
    agreed = lambda name: F.when(F.col(f"{name}_least") == F.col(f"{name}_most"), F.col(f"{name}_least"))
    return told.select("doc_id", "table_no", F.when(F.col("before_least").isNotNull(), agreed("before")).otherwise(agreed("after")).alias("unit")).where("unit is not null")


def label_column(cells_: DataFrame, most: int = 5) -> DataFrame:
    """doc_id, table_no, col: the first of the leading columns where half the cells or more hold words. cells_: doc_id, table_no, col, text."""
    wordy = F.avg(F.col("text").rlike("[A-Za-z]{3}").cast("double"))
    return cells_.where(F.col("col") < most).groupBy("doc_id", "table_no", "col").agg(wordy.alias("share")).where("share >= 0.5").groupBy("doc_id", "table_no").agg(F.min("col").alias("col"))


def transposed(cells_: DataFrame, least: float = 0.5) -> DataFrame:
    """Tables whose first column holds periods. cells_: doc_id, table_no, col, is_period."""
    return cells_.where("col = 0").groupBy("doc_id", "table_no").agg((F.avg(F.col("is_period").cast("double")) >= least).alias("transposed"))


def filled_from_sides(headers: DataFrame) -> DataFrame:
    """Bare-year headers take the wording of the nearest worded header on the left, else on the right. headers: doc_id, table_no, col, wording."""
    by = Window.partitionBy("doc_id", "table_no").orderBy("col")
    left = F.last("wording", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("wording", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    return headers.withColumn("wording", F.coalesce("wording", left, right))


def placed(values: DataFrame) -> DataFrame:
    """values with clash: another value has the same slot. values: doc_id, table_no, row, slot."""
    return values.withColumn("clash", F.count("*").over(Window.partitionBy("doc_id", "table_no", "row", "slot")) > 1)


def joined_numbers(tokens: DataFrame) -> DataFrame:
    """Number tokens of a line, those printed in pieces ("1,2" "34") put together: a piece follows within two points. tokens: doc_id, page, line, x0, x1, text."""
    by = Window.partitionBy(*PAGE, "line").orderBy("x0")
    close = (F.col("x0") - F.lag("x1").over(by) <= 2.0) & F.col("text").rlike(r"^[\d,.]+$") & F.lag("text").over(by).rlike(r"^[(\d,.]+$")
    run = islands(tokens.withColumn("close", close), [*PAGE, "line"], "x0", ~F.coalesce(F.col("close"), F.lit(False)), "token")
    return run.groupBy(*PAGE, "line", "token").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda t: t["text"]), "").alias("text"))


def statement_rows(batches: Iterator[pd.DataFrame], most_blank: int = 6) -> Iterator[pd.DataFrame]:
    """Scan of a document's lines, in order: a label without figures waits for the next line of figures; a table ends after most_blank lines without any. Rows: doc_id, page, line, label, n_figures."""
    for doc in batches:
        out, pending, blank, table = [], "", 0, 0
        for row in doc.sort_values(["page", "line"], kind="stable").to_dict("records"):
            if row["n_figures"] > 0:
                if blank > most_blank or table == 0:
                    table += 1
                out.append((row["doc_id"], table, row["page"], row["line"], " ".join(x for x in (pending, row["label"] or "") if x)))
                pending, blank = "", 0
            else:
                blank += 1
                pending = row["label"] or "" if blank <= most_blank else ""
        yield pd.DataFrame(out, columns=["doc_id", "table_no", "page", "line", "label"])


def scanned_statements(text_lines: DataFrame) -> DataFrame:
    """doc_id, table_no, page, line, label of each row of figures; state goes over page breaks, so a document is one group."""
    kind = dict(text_lines.dtypes)["doc_id"]
    return text_lines.groupBy("doc_id").applyInPandas(lambda doc: next(statement_rows(iter([doc]))), f"doc_id {kind}, table_no long, page long, line long, label string")


def covered_share(boxes: DataFrame, area: float) -> DataFrame:
    """doc_id, page, coverage: image area of the page, 1 at most."""
    return boxes.groupBy(*PAGE).agg(F.least(F.lit(1.0), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / area).alias("coverage"))
