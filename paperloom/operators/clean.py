"""Line-by-line cleaning of extracted document text, aware of its sections.

Lines get their class from built-in expressions; the section they are in and
the block they belong to are running windows over a document's lines.  A
document's lines are shuffled once, by document; the largest unit of work is
one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import collapse_spaces, contains_any, normalize_text, strip, word_count
from paperloom.rules import DROP_HEADINGS, EXCEPTION_WORDS, GIOIA_WORDS, KEEP_HEADINGS, METHODS_HEADINGS, METHODS_WORDS

MIN_WORDS, SCANNED_CHARS_PER_PAGE = 100, 60

# Patterns of lines that are not running text.
DOI_LINE = r"(?iU)^\s*(doi:?\s*)?(https?://(dx\.)?doi\.org/)?10\.\d{4,9}/\S+\s*$"
URL_LINE = r"(?iU)^\s*(https?://|www\.)\S+\s*$"
PAGE_LINE = r"(?iU)^\s*(page\s+)?\d{1,4}\s*$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
AFFILIATION = r"(?iU)^\s*(department|dept\.?|faculty|school|college|institute|centre|center|university|laboratory)\b"
P_VALUE = r"(?iU)\bp\s*[<>=]\s*0?\.\d+"
STATISTIC = r"(?iU)\b([βbtrzfF]|chi|χ2?|se|sd|m)\s*=\s*-?\d"
NUMBER = r"(?U)-?\d+(\.\d+)?"
CITATION = r"(?U)(\([12]\d{3}[a-z]?\).{0,80}\d+(\s*[-–]\s*\d+)?$)|(^\s*[A-Z][A-Za-z'’-]+,\s+[A-Z]\.)"


def heading_form(line: Column) -> Column:
    """A heading without its number (Arabic or Roman letters, also those of a word), other signs and case."""
    t = F.regexp_replace(strip(line), r"(?U)^[\dIVXivx]+[\.\)]?\s*", "")
    return F.regexp_replace(F.lower(strip(F.regexp_replace(t, r"(?U)[^a-zA-Z\s/&-]", ""))), r"(?U)\s+", " ")


def _begins(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(k)) for k in words))


def heading_class(line: Column, form: Column | None = None) -> Column:
    """``drop``, ``methods``, ``keep`` or null: short lines without a final stop that begin like a known heading. ``form`` is the line's :func:`heading_form`, best a column that is there."""
    h = heading_form(line) if form is None else form
    shaped = (line != "") & (F.length(line) <= 70) & ~line.endswith(".") & (h != "") & (word_count(line) <= 8)
    return F.when(shaped, F.when(_begins(h, DROP_HEADINGS), "drop").when(_begins(h, METHODS_HEADINGS), "methods").when(_begins(h, KEEP_HEADINGS), "keep"))


def junk_class(line: Column, low: Column | None = None) -> Column:
    """``doi``, ``url``, ``page``, ``email``, ``affil``, ``stat``, ``table`` or null, the first that fits; for stripped lines."""
    low = F.lower(line) if low is None else low
    digits, solid = F.regexp_count(line, F.lit(r"(?U)\d")), F.length(F.regexp_replace(line, r"(?U)\s", ""))
    return (
        F.when(line == "", F.lit(None).cast("string"))
        .when(F.contains(line, F.lit("10.")) & line.rlike(DOI_LINE), "doi")
        .when((F.contains(low, F.lit("://")) | F.contains(low, F.lit("www."))) & line.rlike(URL_LINE), "url")
        .when(line.rlike(PAGE_LINE), "page")
        .when(F.contains(line, F.lit("@")) & (F.length(line) < 120) & line.rlike(EMAIL), "email")
        .when((F.length(line) < 100) & line.rlike(AFFILIATION) & ~line.rlike(r"[.?!]$"), "affil")
        .when(F.contains(line, F.lit("=")) & line.rlike(STATISTIC) | line.rlike("[<>=]") & line.rlike(P_VALUE) | contains_any(low, ["cronbach", "p-value", "t-value"]), "stat")
        .when((F.regexp_count(line, F.lit(NUMBER)) >= 3) & (solid > 0) & (digits > solid * 0.35), "table")
    )


def has_quote(line: Column) -> Column:
    return (F.length(line) > 25) & (line.rlike("[“”‘’«»]") | (F.regexp_count(line, F.lit('"')) >= 2))


def is_exception(line: Column, low: Column) -> Column:
    return has_quote(line) | contains_any(low, EXCEPTION_WORDS)


def kept_in_dropped(line: Column, low: Column) -> Column:
    return (has_quote(line) | contains_any(low, GIOIA_WORDS)) & ~line.rlike(CITATION)


def kept_in_methods(line: Column, low: Column) -> Column:
    return is_exception(line, low) | contains_any(low, METHODS_WORDS)


def classified_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, pos, line, heading, junk, mode, block, kept)`` for every line of every document; null texts are one empty line."""
    lines = documents.select(doc, F.posexplode(F.split(normalize_text(text), "\n", -1)).alias("pos", "raw")).select(doc, "pos", collapse_spaces("raw").alias("line"))
    lines = lines.withColumns({"h": F.when(F.length("line") <= 70, heading_form(F.col("line"))), "low": F.lower("line")})
    lines = lines.withColumns({"heading": heading_class(F.col("line"), F.col("h")), "junk": junk_class(F.col("line"), F.col("low"))})
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = ((F.col("line") == "") | F.col("heading").isNotNull()).cast("int")
    lines = lines.withColumns({"mode": F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("keep")), "block": F.sum(stop).over(w)})
    line, low = F.col("line"), F.col("low")
    body = (line != "") & F.col("heading").isNull()
    clear = F.col("junk").isNull() | is_exception(line, low)
    by_mode = F.when(F.col("mode") == "drop", kept_in_dropped(line, low)).when(F.col("mode") == "methods", kept_in_methods(line, low)).otherwise(F.lit(True))
    return lines.withColumn("clear", clear).withColumns({"skipped": body & ~F.col("clear"), "kept": body & F.col("clear") & by_mode}).drop("clear", "low")


def clean_documents(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, cleaned, kept_sections, removed_sections, warnings)``, one row per document (``doc`` is unique), also where no line is left.

    Kept lines of a block are joined by a space, blocks by an empty line;
    section names and warnings are arrays, sections in order of appearance,
    warnings sorted.  Lines are gathered block by block and blocks by document,
    in the one shuffle that the windows need.
    """
    lines = classified_lines(documents, doc, text)
    section = F.when(F.col("mode") == "methods", F.concat("line", F.lit(" (minimal/context only)"))).otherwise(F.col("line"))
    listed = lambda holds, *what: F.collect_list(F.when(holds, F.struct("pos", *what)))
    blocks = lines.groupBy(doc, "block").agg(
        F.array_join(F.transform(F.array_sort(listed(F.col("kept"), "line")), lambda e: e["line"]), " ").alias("p"),
        F.count(F.when(F.col("kept"), 1)).alias("n"),
        F.max(F.when(F.col("heading").isin("keep", "methods"), section)).alias("ks"),  # a heading begins its block
        F.max(F.when(F.col("heading") == "drop", F.col("line"))).alias("rs"),
        F.max(F.when((F.col("heading") == "drop") & F.col("h").rlike("^(reference|bibliography)"), "references removed")).alias("w1"),
        F.max(F.when(F.col("skipped") & F.col("junk").isin("stat", "table"), "tables removed")).alias("w2"),
        F.max(F.when(F.col("kept") & (F.col("mode") == "drop"), "qualitative quotes retained")).alias("w3"),
    )
    in_order = lambda holds, name: F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("block", name)))), lambda e: e[name])
    rows = blocks.groupBy(doc).agg(
        F.array_join(in_order(F.col("n") > 0, "p"), "\n\n").alias("cleaned"), in_order(F.col("ks").isNotNull(), "ks").alias("ks"), in_order(F.col("rs").isNotNull(), "rs").alias("rs"), *(F.max(w).alias(w) for w in ("w1", "w2", "w3"))
    )
    none = F.when(F.size("ks") == 0, "no section headings detected; line-level cleaning only")
    warnings = F.array_sort(F.filter(F.array("w1", "w2", "w3", none), lambda x: x.isNotNull()))
    return rows.select(doc, "cleaned", F.col("ks").alias("kept_sections"), F.col("rs").alias("removed_sections"), warnings.alias("warnings"))


def text_state(text: Column, pages: Column, failed: Column | None = None) -> Column:
    """``error`` where ``failed`` holds, else ``no_text``, ``short_scanned``, ``short`` or ``text``: what the extraction of a document yielded."""
    per_page = F.when(F.coalesce(pages, F.lit(0)) > 0, F.length(text) / pages)
    few = word_count(text) < MIN_WORDS
    state = F.when(F.coalesce(failed, F.lit(False)), "error") if failed is not None else F
    return state.when(strip(text) == "", "no_text").when(few & (per_page < SCANNED_CHARS_PER_PAGE), "short_scanned").when(few, "short").otherwise("text")


def notes(meta: dict[str, Column], kept: Column, removed: Column, warnings: Column, words: dict[str, Column]) -> Column:
    """A document's notes in their fixed layout; empty lists are shown as such."""
    listed = lambda a, none: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(none)
    head = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in meta.items()]
    tail = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in words.items()]
    return F.concat_ws("\n", *head, F.lit(""), F.lit("kept_sections:"), listed(kept, "- (none detected)"), F.lit(""), F.lit("removed_sections:"), listed(removed, "- (none detected)"), F.lit(""), F.lit("warnings:"), listed(warnings, "- (none)"), F.lit(""), *tail)
