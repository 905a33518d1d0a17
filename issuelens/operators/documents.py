"""Pages and prose: classes of pages, document types, sectors, narrative facts, issue totals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims
from ..functions.labels import sentences
from ..functions.wording import words_of

# Words that tell a document's type (first found wins); what mentions a sector, and how many mentions it takes.
TYPES = [("draft red herring prospectus", "drhp"), ("red herring prospectus", "rhp"), ("prospectus", "prospectus"), ("annual report", "annual_report"), ("financial statements", "financial_statements"), ("auditor", "financial_statements")]
SECTORS = {
    "lender": (["housing finance company", "housing finance companies", "microfinance", "nbfc", "nbfcs", "non banking financial company", "non banking financial companies", "small finance bank", "small finance banks"], 30),
    "real_estate": (["real estate development", "real estate developments", "real estate project", "real estate projects", "rera", "residential project", "residential projects"], 30),
}
# Facts of declarations, the people they are about, and months of a lock-in.
PEOPLE = ("company", "promoter", "promoters", "director", "directors")
LOCK_IN = {18: ("eighteen months", "18 months"), 36: ("thirty six months", "36 months", "three years", "3 years")}
MONEY = r" (?:₹|`|rs|inr) (\d[\d,]*(?:\.\d+)?) (million|mn|lakhs?|lacs?|crores?|cr)(?= )"
FRESH, SALE = "fresh issue", "offer for sale"


def garbled_ratio(text: Column) -> Column:
    """Share of characters that a broken font leaves: replacement and private-use characters, non-printing ones, and (cid: marks, each worth five."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[\x{FFFD}\x{E000}-\x{F8FF}\x{0000}-\x{0008}\x{000E}-\x{001F}\x{007F}]", ""))
    return F.least(F.lit(1.0), (odd + 5 * F.regexp_count(text, F.lit(r"\(cid:"))).cast("double") / F.greatest(F.length(text), F.lit(1)))


def page_kind(chars: Column, image_coverage: Column, upright: Column, garbled: Column) -> Column:
    return F.when((chars < 25) & (image_coverage < 0.05), "blank").when(chars < 25, "scanned").when(garbled > 0.2, "garbled").when(upright < 0.5, "rotated").otherwise("native")


def needs_ocr(alphanumerics: Column, images: Column) -> Column:
    return (alphanumerics < 25) & (images > 0)


def tabular(lines: DataFrame) -> DataFrame:
    """doc_id, page, tabular: two period cells or four numeric lines. lines: doc_id, page, text."""
    period, numeric = F.col("text").rlike(r"(?i)\b(?:fy|fiscal|march 31|as at)\b"), F.regexp_count("text", F.lit(r"\d[\d,]*\.?\d*")) >= 2
    return lines.groupBy("doc_id", "page").agg(((F.count_if(period) >= 2) | (F.count_if(numeric) >= 4)).alias("tabular"))


def document_type(head: Column) -> Column:
    low = F.lower(head)
    return F.coalesce(*[F.when(F.contains(low, F.lit(words)), F.lit(kind)) for words, kind in TYPES])


def sectors(pages: DataFrame, front: int = 150, found: dict[str, tuple[list[str], int]] | None = None) -> DataFrame:
    """doc_id, sector, mentions where they reach the threshold, over the first pages."""
    kinds = found or SECTORS
    rows = pages.where(F.col("page") <= front).select("doc_id", words_of(F.col("text")).alias("words"))
    # Mentions may share the blank between them.
    mentions = lambda phrases: sum((F.regexp_count("words", F.lit(f" {p}(?= )")) for p in phrases), F.lit(0))
    counted = rows.groupBy("doc_id").agg(*[F.sum(mentions(phrases)).alias(s) for s, (phrases, _) in kinds.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("sector"), F.col(s).alias("mentions"), F.lit(t).alias("threshold")) for s, (_, t) in kinds.items()])
    return counted.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*").where("mentions >= threshold")


def first_hits(pages: DataFrame, facts: dict[str, Column], **read: Column) -> DataFrame:
    """doc_id, fact, page, snippet of the first sentence that states each fact (a condition on words, its text with a blank around each word), and what is read from the whole of it; only the snippet is cut."""
    rows = pages.select("doc_id", "page", F.posexplode(sentences(F.col("text"))).alias("place", "sentence")).withColumn("words", words_of(F.col("sentence")))
    hits = F.array_compact(F.array(*[F.when(stated, F.lit(fact)) for fact, stated in facts.items()]))
    told = rows.select("doc_id", "page", "place", "sentence", "words", F.explode(hits).alias("fact"))
    kept = [F.substring("sentence", 1, 400).alias("snippet"), *[c.alias(k) for k, c in read.items()]]
    return told.groupBy("doc_id", "fact").agg(F.min(F.struct("page", "place", *kept)).alias("m")).select("doc_id", "fact", "m.page", "m.snippet", *[f"m.{k}" for k in read])


def said(words: Column, *phrases: str) -> Column:
    """Does the text of words (a blank around each) hold one of the phrases?"""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(words, F.lit(f" {p} "))
    return out


def _declared(w: Column) -> dict[str, Column]:
    """Which facts a sentence of words w states, and the value."""
    barred, which = claims.places(w, "debarred", "prohibited"), claims.places(w, "which")
    people, firm = claims.places(w, *PEOPLE), claims.places(w, "company", "companies")
    # "... of any company which is debarred" is about that company.
    of_another = claims.behind(claims.behind(firm, which, 1), barred, 3)
    own = claims.without(barred, which, 3)
    refused = claims.behind(claims.behind(claims.places(w, *claims.AUXILIARIES), claims.places(w, "not"), 1), own, 2)
    nobody, locked = claims.places(w, "none", "neither"), claims.places(w, "locked in")
    months = {m: claims.has(claims.behind(claims.behind(locked, claims.places(w, "period"), 4), claims.places(w, *phrases), 2)) for m, phrases in LOCK_IN.items()}
    least = claims.behind(claims.places(w, "not less than 75%"), claims.places(w, "net offer"), 8)
    false = lambda stated: F.when(stated, "false")
    return {
        "declarations.debarred_by_sebi": false(claims.has(claims.ahead(people, claims.ahead(refused, claims.places(w, "securities", "capital market*"), 25), claims.SCOPE))),
        "declarations.promoter_or_director_of_debarred_company": false(claims.has(claims.behind(claims.behind(nobody, claims.places(w, "promoter", "promoters", "director", "directors"), 25), of_another, claims.SCOPE))),
        "declarations.wilful_defaulter_or_fraudulent_borrower": false(claims.denied(w, claims.places(w, "wilful defaulter*"))),
        "declarations.fugitive_economic_offender": false(claims.denied(w, claims.places(w, "fugitive economic offender*"))),
        "issue_details.qib_net_offer_allocation": F.when(claims.has(claims.behind(least, claims.places(w, "allot*", "alloc*"), 8)), "75"),
        "promoter.lock_in_months": F.when(claims.has(claims.places(w, "promoter*")), F.when(months[18], "18").when(months[36], "36")),
    }


#: The words of which a sentence has to hold one to state a fact.
CUES = {
    "declarations.debarred_by_sebi": ("debarred", "prohibited"),
    "declarations.promoter_or_director_of_debarred_company": ("debarred", "prohibited"),
    "declarations.wilful_defaulter_or_fraudulent_borrower": ("wilful",),
    "declarations.fugitive_economic_offender": ("fugitive",),
    "issue_details.qib_net_offer_allocation": ("75%",),
    "promoter.lock_in_months": ("locked",),
}


def narrative(pages: DataFrame) -> DataFrame:
    """doc_id, fact, page, snippet, value of the first sentence that states it: standard negative declarations, the 75 % allotment and lock-in months.

    Words are taken only from sentences that hold a cue's letters, and a fact is looked for only where its cue is a word.
    """
    cues = sorted({c for of_fact in CUES.values() for c in of_fact})
    rows = pages.select("doc_id", "page", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    low = F.lower("sentence")
    rows = rows.where(reduce(or_, (F.contains(low, F.lit(c)) for c in cues))).withColumn("words", words_of(F.col("sentence")))
    # One pattern: a filter moves below the words, and would take them anew for each phrase.
    rows = rows.where(F.col("words").rlike(f" (?:{'|'.join(cues)}) ")).withColumn("w", claims.word_list(F.col("sentence")))
    values = _declared(F.col("w"))
    stated = F.array(*[F.struct(F.lit(fact).alias("fact"), F.when(said(F.col("words"), *of_fact), values[fact]).alias("value")) for fact, of_fact in CUES.items()])
    told = rows.select("doc_id", "page", "place", F.substring("sentence", 1, 400).alias("snippet"), F.explode(F.filter(stated, lambda x: x["value"].isNotNull())).alias("x"))
    return told.groupBy("doc_id", "x.fact").agg(F.min(F.struct("page", "place", "snippet", "x.value")).alias("m")).select("doc_id", "fact", "m.page", "m.snippet", "m.value")


def suggestions(pages: DataFrame) -> DataFrame:
    """doc_id, suggestion, value, page, snippet: listing route, book building and issue type as sentences state them.

    A sentence on Regulation 6(2) decides the route, the last one; else the first on 6(1). Fresh issue and offer for sale
    in one sentence are a mixed issue; without such a sentence, what the first five pages name decides.
    """
    rows = pages.select("doc_id", "page", F.posexplode(sentences(F.col("text"))).alias("place", "sentence")).withColumn("words", words_of(F.col("sentence")))
    w, at = F.col("words"), F.struct("page", "place", F.substring("sentence", 1, 400).alias("snippet"))
    eligible = F.contains(w, F.lit(" eligib"))
    told = rows.groupBy("doc_id").agg(
        F.max(F.when(eligible & said(w, "regulation 6 ( 2 )"), at)).alias("second"), F.min(F.when(eligible & said(w, "regulation 6 ( 1 )"), at)).alias("first"),
        F.min(F.when(said(w, "book building process"), at)).alias("built"), F.min(F.when(said(w, FRESH) & said(w, SALE), at)).alias("mixed"),
        F.bool_or((F.col("page") <= 5) & said(w, FRESH)).alias("fresh"), F.bool_or((F.col("page") <= 5) & said(w, SALE)).alias("sale"),
    )
    cover = F.when(F.col("fresh") & F.col("sale"), "mixed").when(F.col("fresh"), "fresh").when(F.col("sale"), "offer_for_sale")
    row = lambda name, value, place: F.when(value.isNotNull(), F.struct(F.lit(name).alias("suggestion"), value.alias("value"), F.coalesce(place["page"], F.lit(1)).cast("long").alias("page"), F.coalesce(place["snippet"], F.lit("cover-page offer description")).alias("snippet")))
    found = F.array(
        row("listing_route", F.when(F.col("second").isNotNull(), "mainboard_reg6_2").when(F.col("first").isNotNull(), "mainboard_reg6_1"), F.coalesce("second", "first")),
        row("is_book_built", F.when(F.col("built").isNotNull(), "true"), F.col("built")),
        row("issue_type", F.when(F.col("mixed").isNotNull(), "mixed").otherwise(cover), F.col("mixed")),
    )
    return told.select("doc_id", F.explode(F.array_compact(found)).alias("s")).select("doc_id", "s.*")


def issue_type(head: Column) -> Column:
    fresh, ofs = F.contains(F.lower(head), F.lit(FRESH)), F.contains(F.lower(head), F.lit(SALE))
    return F.when(fresh & ofs, "mixed").when(fresh, "fresh").when(ofs, "offer_for_sale")


def route(text: Column) -> Column:
    """The regulation that the offer is first said to be made under."""
    clause = F.substring(F.get(F.split(words_of(text), " made pursuant to regulation 6 (?=\\( [12] \\) of )"), F.lit(1)), 3, 1)
    return F.when(clause.isNotNull(), F.concat(F.lit("6("), clause, F.lit(")")))


def amounts(text: Column) -> Column:
    """All amounts with a currency and a unit, in words."""
    return F.regexp_extract_all(words_of(text), F.lit(MONEY), F.lit(0))


def most_printed(mentions: DataFrame) -> DataFrame:
    """doc_id, key, value: the value mentioned most often, of those the first. mentions: doc_id, key, value, place."""
    counted = mentions.groupBy("doc_id", "key", "value").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    return counted.groupBy("doc_id", "key").agg(F.max_by(F.struct("value", "n"), F.struct("n", -F.col("first"))).alias("m")).select("doc_id", "key", "m.value", "m.n")


def issue_totals(mentions: DataFrame, step: float = 1.0) -> DataFrame:
    """doc_id, fresh, ofs, total: the best-scoring triple that adds up, else the value printed most for each. mentions: doc_id, key, value, place.

    A document names a handful of values for each key, so its triples are few.
    """
    counted = mentions.groupBy("doc_id", "key", "value").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    of = lambda k: F.collect_list(F.when(F.col("key") == k, F.struct(F.col("value").cast("double").alias("v"), F.col("n").alias("n"), F.col("first").alias("first"))))
    sides = counted.groupBy("doc_id").agg(*[F.array_sort(of(k), lambda a, b: (a["first"] - b["first"]).cast("int")).alias(k) for k in ("fresh", "ofs", "total")])
    triples = F.flatten(F.transform("fresh", lambda f: F.flatten(F.transform("ofs", lambda o: F.transform("total", lambda t: F.struct((f["n"] + o["n"] + t["n"]).alias("score"), (-(f["first"] + o["first"] + t["first"])).alias("early"), f["v"].alias("fresh"), o["v"].alias("ofs"), t["v"].alias("total")))))))
    good = F.array_max(F.filter(triples, lambda x: F.abs(x["fresh"] + x["ofs"] - x["total"]) <= 2 * step))
    mode = lambda k: F.array_max(F.transform(k, lambda x: F.struct(x["n"].alias("n"), (-x["first"]).alias("early"), x["v"].alias("v"))))["v"]
    return sides.withColumn("good", good).select("doc_id", *[F.coalesce(F.col(f"good.{k}"), mode(k)).alias(k) for k in ("fresh", "ofs", "total")])


def debt_total(rows: DataFrame) -> DataFrame:
    """doc_id, value: the sum of the rows, unless one of them is the sum of the others. rows: doc_id, value."""
    gathered = rows.groupBy("doc_id").agg(F.sum("value").alias("sum"), F.max("value").alias("most"))
    return gathered.select("doc_id", F.when(F.abs(F.col("sum") - 2 * F.col("most")) <= 0.02, F.col("most")).otherwise(F.col("sum")).alias("value"))


def running_totals(rows: DataFrame) -> DataFrame:
    """table_id, foots: a row that says Total equals the sum of two or more positive rows above it. rows: table_id, row_no, label, value."""
    is_total = F.lower("label").startswith("total")
    above = Window.partitionBy("table_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.withColumns({"so_far": F.sum(F.when(~is_total & (F.col("value") > 0), F.col("value"))).over(above), "parts": F.count_if(~is_total & (F.col("value") > 0)).over(above)})
    return sums.where(is_total).groupBy("table_id").agg(F.bool_or((F.col("parts") >= 2) & (F.abs(F.col("so_far") - F.col("value")) <= 0.02)).alias("foots"))


def monitoring_agency(pages: DataFrame) -> DataFrame:
    """doc_id, appointed: true or false if sentences state one of the two and none the other.

    An agency is appointed if "appointed" stands behind has or have (or before "as"), not behind "not", and near the agency,
    or before what it is to monitor. There is none if "no" stands before the agency, or a negation before "appointed",
    "required", "applicable" or "necessary" in a sentence about it.
    """
    rows = pages.select("doc_id", F.explode(sentences(F.col("text"))).alias("sentence"))
    rows = rows.where(F.lower("sentence").contains("monitor")).withColumn("w", claims.word_list(F.col("sentence")))
    w = F.col("w")
    agency, verb = claims.places(w, "monitoring agency"), claims.places(w, "appointed")
    use = claims.behind(claims.places(w, "to monitor"), claims.places(w, "utilisation", "utilization", "use", "deployment"), 4)
    not_ = claims.places(w, "not")
    done = claims.without(claims.without(verb, not_, 2), claims.places(w, "be"), 1)
    done = F.array_union(claims.behind(claims.places(w, "has", "have"), done, 2), claims.ahead(done, claims.places(w, "as"), 12))
    near = claims.has(claims.ahead(done, F.concat(agency, use), 25)) | claims.has(claims.behind(agency, done, 16))
    refused = claims.behind(not_, claims.places(w, "appointed", "required", "applicable", "necessary"), 2)
    none = claims.has(claims.behind(claims.places(w, "no"), agency, 1)) | claims.has(claims.ahead(refused, agency, 6)) | claims.has(claims.behind(agency, refused, 20))
    told = rows.groupBy("doc_id").agg(F.bool_or(near).alias("y"), F.bool_or(none).alias("n"))
    return told.where(F.col("y") != F.col("n")).select("doc_id", F.col("y").cast("int").alias("appointed"))


def objects_table(cells: DataFrame) -> DataFrame:
    """table_id of tables with a unit that mention Net Proceeds or foot. cells: table_id, unit, label, foots."""
    return cells.groupBy("table_id").agg(F.bool_or(F.col("unit").isNotNull()).alias("u"), F.bool_or(F.contains(F.lower("label"), F.lit("net proceeds"))).alias("m"), F.bool_or("foots").alias("f")).where("u and (m or f)").select("table_id")
