"""The registered queries: the reference's operators and the general data-preparation ones, over the driver's tables.

Every query runs over its whole tables.  The order of candidates is ``cand_no``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schema
from paperloom.functions import text as T
from paperloom.operators import clean, dedup, grid, keywords, organize
from paperloom.operators.split_values import split_values
from paperloom.operators.upsert import enrich, upsert
from paperloom.plans import pipeline
from paperloom.rules import CANDIDATE_COLUMNS, CATEGORIES, COUNTRIES
from paperloom.rules import QUERIES as SEARCH_QUERIES
from paperloom.sources import fetch, files, payloads, search, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_values(read(spark, d, "candidates"), "cand_no", ("authors", "related_category", "target_country_region"), ("authors",))


# --- string functions and projections


@query
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    return c.select("cand_no", T.normalize_title("title").alias("norm_title"), T.slugify("title").alias("slug"), T.short_title("title").alias("short_title"), T.token_sort(T.normalize_title("title")).alias("sorted_title"))


@query
def record_ids(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    rid = T.record_id("doi", "title", "doi", "title", "authors", "year")
    return c.select("cand_no", F.when(rid.startswith("raw:"), "raw:").otherwise(rid).alias("rid"))


@query
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "candidates").select(T.host("pdf_url").alias("host")).groupBy("host").agg(F.count("*").alias("n"))


@query
def plain_abstracts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "candidates").select("cand_no", T.strip_tags("abstract").alias("plain"), T.word_count("abstract").alias("n_words"))


@query
def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").withColumn("ix", payloads.inverted_index("abstract"))
    return c.select("cand_no", payloads.abstract_from_index("ix").alias("rebuilt"), F.size("ix").alias("n_words"))


@query
def csv_projection(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    return sinks.fixed_columns(c.withColumn("key", F.col("cand_no").cast("string")), ["key", *CANDIDATE_COLUMNS])


@query
def aliased_columns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").withColumnsRenamed({"local_pdf_path": "pdf_path", "screening_status": "status"})
    names = ("country", "category", "title", "local_pdf_path", "screening_status")
    return c.select("cand_no", *(organize.pick(c, n).alias(n) for n in names))


@query
def target_paths(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    return c.select("cand_no", organize.target_path(F.col("country"), F.col("slot"), F.col("title")).alias("target"), organize.source_path(F.coalesce("local_pdf_path", F.lit("")), "/data").alias("source"))


@query
def leading_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The count that a category text begins with, the year, and a limit clamped to a page."""
    c = read(spark, d, "candidates")
    return c.select("cand_no", T.whole_number(F.split(T.text("related_category"), " ")[0]).alias("n_matches"), T.whole_number(F.col("year").cast("string")).alias("year_no"), T.clamp(F.coalesce("year", F.lit(0)), 1, 200).alias("page_size"))


@query
def category_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The number of every row's category as stored; other spellings are tested on a fixture."""
    return read(spark, d, "candidates").select("cand_no", organize.category_number(F.col("category")).alias("category_no"))


@query
def file_names_parsed(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "preprocess_log")
    return p.select("log_no", organize.parsed_name(F.coalesce("pdf_file", F.lit("")), F.col("country"), COUNTRIES).alias("m")).select("log_no", "m.*")


@query
def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"))


# --- payloads of search interfaces


@query
def works_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Candidates written as nested work payloads (JSON) and read back through the schema and the normaliser."""
    c = read(spark, d, "candidates")
    authors = F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.struct(F.struct(F.trim(a).alias("display_name")).alias("author")))
    raw = F.struct(
        F.col("openalex_id").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.when(F.col("cand_no") % 2 == 0, F.col("title")).alias("title"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), authors.alias("authorships"),
        F.struct(F.col("url").alias("landing_page_url"), F.struct(F.col("journal_source").alias("display_name")).alias("source")).alias("primary_location"),
        F.struct("pdf_url", F.lit(None).cast("string").alias("version"), "license").alias("best_oa_location"), F.struct("is_oa", "oa_status").alias("open_access"), payloads.inverted_index("abstract").alias("abstract_inverted_index"),
    )
    back = c.select("cand_no", F.from_json(F.to_json(raw), schema.WORK).alias("w")).select("cand_no", "w.*")
    out = payloads.works(back.withColumn("id", F.to_json(F.struct("cand_no", F.col("id").alias("i")))))
    keys = F.from_json("openalex_id", "cand_no bigint, i string")
    return out.select(keys["cand_no"].alias("cand_no"), "doi", "title", "authors", "year", "journal_source", "pdf_url", "oa_status", "oa_source", "license", "abstract", "is_oa")


@query
def items_normalised(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    names = F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.struct(F.nullif(F.trim(F.substring_index(a, ",", -1)), F.lit("")).alias("given"), F.when(F.contains(a, F.lit(",")), F.trim(F.substring_index(a, ",", 1))).alias("family")))
    part = lambda cond: F.struct(F.when(cond, F.array(F.array("year"))).alias("date-parts"))
    raw = F.struct(
        F.array("title").alias("title"), names.alias("author"), F.array(F.col("journal_source")).alias("container-title"), F.col("doi").alias("DOI"), F.col("cand_no").cast("string").alias("URL"), F.concat(F.lit("<jats:p>"), "abstract", F.lit("</jats:p>")).alias("abstract"),
        part(F.col("cand_no") % 3 == 0).alias("published-print"), part(F.col("cand_no") % 3 == 1).alias("published-online"), part(F.lit(True)).alias("issued"), part(F.lit(False)).alias("created"),
    )
    out = payloads.items(c.select(F.from_json(F.to_json(raw), schema.ITEM).alias("i")).select("i.*"))
    return out.select(F.col("url").cast("bigint").alias("cand_no"), "doi", "title", "authors", "year", "journal_source", "abstract")


@query
def papers_normalised(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    names = F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.struct(F.trim(a).alias("name")))
    raw = F.struct(F.col("cand_no").cast("string").alias("paperId"), "title", "abstract", "year", names.alias("authors"), F.col("journal_source").alias("venue"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"), F.col("is_oa").alias("isOpenAccess"))
    out = payloads.papers(c.select(F.from_json(F.to_json(raw), schema.PAPER).alias("p")).select("p.*"), page="")
    return out.select(F.col("url").cast("bigint").alias("cand_no"), "doi", "title", "authors", "year", "journal_source", "pdf_url", "oa_status", "oa_source", "abstract", "is_oa")


@query
def cell_queries(spark: SparkSession, d: str) -> DataFrame:
    """The search queries of every place of the grid."""
    return search.cell_queries(spark, grid.grid(spark), SEARCH_QUERIES)


@query
def collected(spark: SparkSession, d: str) -> DataFrame:
    """Works found for their cells, from the payload to the scored candidate with its id."""
    cells = read(spark, d, "candidates").select("cand_no", "country", "category")
    out = pipeline.collect(works_normalised(spark, d).join(cells, "cand_no"), F.lit("2024-01-01T00:00:00+00:00"))
    cols = ["country", "category", "slot", "local_pdf_path", "notes", "duplicate_of", "created_at", "updated_at", "country_score", "category_score", "workplace_organization_score", "exclusion_medical_score"]
    return out.select("cand_no", F.when(F.col("id").startswith("raw:"), "raw:").otherwise(F.col("id")).alias("id"), *cols)


@query
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with the lookup record of its DOI; lookups are made of the log."""
    log = read(spark, d, "download_safety_log").groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.min("pdf_url").alias("u"), F.max("license").alias("l"), F.max("oa_status").alias("oa_status"))
    best = F.struct(F.col("u").alias("url_for_pdf"), F.col("l").alias("license"), F.lit(None).cast("string").alias("host_type"))
    out = payloads.looked_up(read(spark, d, "candidates").select("cand_no", "doi"), log.select("doi", F.col("u").isNotNull().alias("is_oa"), "oa_status", best.alias("best_oa_location")))
    return out.select("cand_no", "l_is_oa", "l_oa_status", "l_pdf_url", "l_license", "l_host_type")


# --- limits, unions, sets


@query
def limited_per_query(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").select("country", "category", "cand_no", "id")
    return grid.ranked(c, [F.asc("cand_no")], top=20).select("country", "category", "rn", "cand_no", "id")


@query
def united_sources(spark: SparkSession, d: str) -> DataFrame:
    c, s = read(spark, d, "candidates"), read(spark, d, "download_safety_log")
    u = c.select("country", "category", "title", "doi", "pdf_url", F.lit("candidate").alias("kind")).unionByName(s.select("country", "category", "title", "doi", "domain", F.lit("log").alias("kind")), allowMissingColumns=True)
    return u.groupBy("kind", "country", "category").agg(F.count("*").alias("n"), F.count(T.col("domain")).alias("n_domain"), F.count(F.when(T.present("doi"), 1)).alias("n_doi"))


@query
def targets(spark: SparkSession, d: str) -> DataFrame:
    g = grid.grid(spark)
    n = read(spark, d, "candidates").groupBy("country", "category").agg(F.count("*").alias("n"))
    return g.join(n, ["country", "category"], "left").select("country", "category", "category_no", "paper", "slot", F.coalesce("n", F.lit(0)).alias("n"))


@query
def taken_slots(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").where(T.present("slot"))
    return c.groupBy("country", "category").agg(F.array_join(F.array_sort(F.collect_set("slot")), ",").alias("slots"), F.count("*").alias("n"))


# --- keyword scores


@query
def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    s = keywords.score(read(spark, d, "candidates"))
    return s.select("cand_no", "country_score", "workplace_organization_score", "category_score", "exclusion_medical_score", "target_country_region", "research_context", "related_category", "reason_for_inclusion")


@query
def workplace_checked(spark: SparkSession, d: str) -> DataFrame:
    return keywords.workplace(read(spark, d, "candidates")).select("cand_no", "in_workplace", F.array_join("workplace_hits", ", ").alias("hits"))


@query
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    s = keywords.score(read(spark, d, "documents").select("doc_id", "text", F.col("country"), F.lit(CATEGORIES[2]).alias("category")), texts=("text",))
    return s.groupBy("country").agg(F.count("*").alias("n"), F.sum("workplace_organization_score").alias("organisation"), F.sum("exclusion_medical_score").alias("medical"), F.sum("category_score").alias("category_words"), F.sum("country_score").alias("country_words"))


# --- places, ranks, numbers, names


def _best() -> list[Column]:
    weight = grid.weighted(F.col("screening_status"), {"strong_candidate": 4, "candidate": 3, "manual_download_needed": 2, "needs_review": 1})
    return [F.desc(weight), F.desc(F.coalesce("category_score", F.lit(0))), F.desc(T.present("pdf_url").cast("int")), F.desc(F.coalesce("year", F.lit(0))), F.asc("cand_no")]


@query
def ranked_in_cell(spark: SparkSession, d: str) -> DataFrame:
    return grid.ranked(read(spark, d, "candidates"), _best(), top=2).select("country", "category", "rn", "cand_no")


@query
def places_filled(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    places = grid.grid(spark, papers=9)
    return grid.fill_places(c, places, _best(), F.col("category_score") >= 1, papers=9).select("country", "category", "rn", "new_slot", "cand_no")


@query
def places_open(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    filled = (F.col("category_score") >= 2) & (F.col("batch_no") == 0)
    action = F.when(F.col("paper") == 1, "find first paper").otherwise("find second paper")
    return grid.open_places(grid.grid(spark), c, filled).select("country", "category", "slot", F.lit("missing").alias("status"), action.alias("needed_action"))


@query
def files_numbered(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").withColumn("category_no", organize.category_number(F.col("category")))
    weight = F.when(F.col("batch_no") == 0, 0).otherwise(9)
    out = organize.numbered(c, ("country", "category_no"), [weight, F.lower(T.strip("title")), F.asc("cand_no")], T.present("local_pdf_path"))
    name = F.when(F.col("sequence").isNotNull(), organize.file_name(F.col("country"), F.col("category_no"), F.col("sequence"), F.col("title"))).otherwise("")
    return out.select("cand_no", "sequence", name.alias("file_name"))


@query
def names_freed(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").select("cand_no", F.col("country").alias("folder"), F.concat(T.short_title("title"), F.lit(".pdf")).alias("name"))
    taken = read(spark, d, "documents").join(c.select("cand_no", "folder", "name"), "cand_no").select("folder", "name").distinct()
    return organize.free_names(c, taken, order="cand_no").select("cand_no", "folder", "free_name")


def _has_document(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").join(read(spark, d, "documents").select("cand_no").distinct(), "cand_no", "left_semi")
    return c.select(organize.source_path(F.coalesce("local_pdf_path", F.lit("")), "/data").alias("path")).distinct()


@query
def files_there(spark: SparkSession, d: str) -> DataFrame:
    """Whether a candidate's file is in the listing of those that documents were made of."""
    c = read(spark, d, "candidates").select("cand_no", organize.source_path(F.coalesce("local_pdf_path", F.lit("")), "/data").alias("path"))
    return files.with_existence(c, _has_document(spark, d)).select("cand_no", "there")


@query
def organised(spark: SparkSession, d: str) -> DataFrame:
    """The plan of tidy copies, with its log."""
    c = read(spark, d, "candidates")
    weight = grid.weighted(F.col("screening_status"), {"adopted": 0, "strong_candidate": 1, "candidate": 2}, 9)
    taken = c.where("cand_no % 2 = 0").select("country", F.concat(F.col("country"), F.lit("_1-1_"), T.short_title("title"), F.lit(".pdf")).alias("name")).distinct()
    out = organize.organise(c, _has_document(spark, d), taken, "/out", "/data", weight, F.col("batch_no") == 3, "cand_no", COUNTRIES)
    return out.select("cand_no", "category_number", "sequence", "new_path", "status", "note")


@query
def saved_count(spark: SparkSession, d: str) -> DataFrame:
    """Files saved by a run: downloaded, and not there before."""
    log, c = read(spark, d, "download_safety_log"), read(spark, d, "candidates").select("cand_no", F.col("batch_no").alias("b"))
    new = (F.col("legal_download_status") == "safe_downloaded") & (F.col("b") > 0)
    return log.join(c, "cand_no").agg(F.count_if(new).alias("saved"), F.count("*").alias("looked_at"))


@query
def download_rows(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates")
    path = F.when(F.col("batch_no") == 0, F.concat(F.lit("pdfs/"), F.col("cand_no").cast("string"))).otherwise("")
    return sinks.download_log(c, T.host("pdf_url"), F.col("legal_download_status"), F.col("legal_download_reason"), path)


@query
def magic_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose first bytes, or whose type, are those of a PDF."""
    t = read(spark, d, "documents")
    head = F.encode(F.concat(F.when(F.col("pages") > 1, "%PDF-").otherwise(""), F.substring("text", 1, 100)), "utf-8")
    return t.select("doc_id", fetch.looks_pdf(head).alias("magic"), fetch.looks_pdf(head, F.when(F.col("lang") == "en", "Application/PDF; x")).alias("either"))


@query
def run_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates and times as text."""
    e = read(spark, d, "events").groupBy("event_type").agg(F.max("ts").cast("timestamp").alias("t"))
    return e.select("event_type", T.iso_seconds(F.col("t")).alias("newest"), T.today().alias("today"))


@query
def status_tally(spark: SparkSession, d: str) -> DataFrame:
    return organize.tally(read(spark, d, "preprocess_log"), "status")


@query
def warnings_sorted(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "preprocess_log").select("doc_id", F.explode(F.split(F.coalesce("warnings", F.lit("")), r"\s*;\s*")).alias("w")).where("w <> ''")
    return p.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("w")), "; ").alias("warnings"))


# --- keyed joins


@query
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Later batches folded into the accepted history by id."""
    c = read(spark, d, "candidates")
    cols = ["title", "authors", "year", "doi", "slot", "notes", "is_oa", "category_score", "screening_status", "created_at"]
    c = c.select("id", F.col("cand_no").alias("ord"), "batch_no", *cols)
    out = upsert(c.where("batch_no = 0").drop("batch_no"), c.where("batch_no > 0").drop("batch_no"), locked={"screening_status": ["needs_review", "rejected"]})
    return out.select("id", F.col("first_at._new").alias("first_new"), F.col("first_at._at").alias("first_no"), *cols)


@query
def enriched(spark: SparkSession, d: str) -> DataFrame:
    c, log = read(spark, d, "candidates"), read(spark, d, "download_safety_log")
    look = log.select("doi", "oa_status", "license", F.col("pdf_url").alias("address")).distinct()
    fill = {"oa_status": F.col("l_oa_status"), "license": F.col("l_license"), "pdf_url": F.col("l_address")}
    return enrich(c, look, "doi", fill).select("cand_no", "oa_status", "license", "pdf_url", (F.coalesce("is_oa", F.lit(False)) | T.present("pdf_url")).alias("is_oa"))


@query
def same_doi_first(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").select("cand_no", F.lower(T.strip("doi")).alias("k"))
    return dedup.first_by_key(c, "k", "cand_no")


@query
def same_title_first(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "candidates").select("cand_no", T.normalize_title("title").alias("k"))
    return dedup.first_by_key(c, "k", "cand_no")


@query
def duplicates_exact(spark: SparkSession, d: str) -> DataFrame:
    """Greedy originals over DOI and title; tested against the sequential rule."""
    return dedup.deduplicate(read(spark, d, "candidates"), "cand_no", fuzzy=False)


@query
def duplicates_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The same with similar titles; tested against the sequential rule."""
    return dedup.deduplicate(read(spark, d, "candidates"), "cand_no")


# --- document text


@query
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    lines = clean.classified_lines(read(spark, d, "documents"))
    return lines.groupBy("heading", "junk", "mode", "kept").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query
def documents_cleaned(spark: SparkSession, d: str) -> DataFrame:
    c = clean.clean_documents(read(spark, d, "documents"))
    return c.select("doc_id", "cleaned", F.array_join("kept_sections", "|").alias("kept_sections"), F.array_join("removed_sections", "|").alias("removed_sections"), F.array_join("warnings", "; ").alias("warnings"))


@query
def text_states(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    return t.select("doc_id", T.word_count("text").alias("n_words"), clean.text_state(F.col("text"), F.col("pages")).alias("state"))


@query
def document_notes(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned documents with their notes rendered; tested on a fixture."""
    t = read(spark, d, "documents").select("doc_id", "paper_id", "country", "category_number", T.word_count("text").alias("raw_words"))
    c = clean.clean_documents(read(spark, d, "documents")).join(t, "doc_id")
    meta = {k: F.col(k) for k in ("paper_id", "country", "category_number")}
    return c.select("doc_id", clean.notes(meta, F.col("kept_sections"), F.col("removed_sections"), F.col("warnings"), {"word_count_raw": F.col("raw_words"), "word_count_cleaned": T.word_count("cleaned")}).alias("notes"))


@query
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The newest log row of each document: late and repeated rows do not count twice."""
    p = read(spark, d, "preprocess_log")
    newest = F.max_by(F.struct("log_no", "status", "word_count_raw", "word_count_cleaned"), F.struct("processed_at", "log_no"))
    return p.groupBy("doc_id").agg(newest.alias("r")).select("doc_id", "r.*")
