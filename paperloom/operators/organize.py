"""Names for files: sequence numbers in their group, free names, and what names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import short_title, slugify, strip, text
from paperloom.operators.ranks import group_rank
from paperloom.rules import CATEGORIES, COLUMN_ALIASES
from paperloom.sources.files import with_existence


def pick(df: DataFrame, name: str, aliases: dict[str, list[str]] = COLUMN_ALIASES) -> Column:
    """The first of a column's names that is there and not empty, stripped; ``''`` if none is."""
    there = [F.when(F.col(c).cast("string") != "", strip(F.col(c).cast("string"))) for c in aliases.get(name, [name]) if c in df.columns]
    return F.coalesce(*there, F.lit(""))


def category_number(c: Column, categories: list[str] = CATEGORIES) -> Column:
    """The number of a category by its name, by a leading digit, or by its name in any case; null if unknown."""
    exact, loose = None, None
    low = F.lower(strip(c))
    for i, name in enumerate(categories, 1):
        exact = F.when(c == name, i) if exact is None else exact.when(c == name, i)
        loose = F.when(low == name.lower(), i) if loose is None else loose.when(low == name.lower(), i)
    lead = F.regexp_extract(text(c), rf"(?U)^\s*([1-{len(categories)}])\b", 1)
    return F.coalesce(exact, F.when(lead != "", lead.cast("int")), loose)


def numbered(records: DataFrame, group: tuple[str, ...], by: list[Column], ok: Column) -> DataFrame:
    """``records`` with ``sequence``: the rank of the rows for which ``ok`` holds in their group; null for the others."""
    r = records.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    ranked = group_rank(r.where("_ok"), list(group), by, "sequence")
    return ranked.unionByName(r.where("not _ok").withColumn("sequence", F.lit(None).cast("int"))).drop("_ok")


def file_name(country: Column, category_no: Column, sequence: Column, title: Column) -> Column:
    return F.concat(country, F.lit("_"), category_no.cast("string"), F.lit("-"), sequence.cast("string"), F.lit("_"), short_title(title), F.lit(".pdf"))


def free_names(wanted: DataFrame, taken: DataFrame, name: str = "name", folder: str = "folder", order: str = "ord") -> DataFrame:
    """``wanted`` with ``free_name``: its name, or with ``_dupN`` before the extension, N the smallest that is free in its folder whatever the case.

    ``taken`` holds ``(folder, name)`` of the files there are.  Rows that want
    one name get it in order of ``order``, the later ones the next free N.
    """
    stem = F.regexp_extract(F.lower(name), r"^(.*?)(?:_dup\d+)?(\.[^.]*)?$", 1)
    n = F.regexp_extract(F.lower(name), r"_dup(\d+)(?:\.[^.]*)?$", 1)
    used = taken.select(F.col(folder).alias("_f"), stem.alias("_s"), F.when(n == "", 0).otherwise(F.try_to_number(n, F.lit("999999999")).cast("int")).alias("_n"))
    used = used.groupBy("_f", "_s").agg(F.array_sort(F.collect_set("_n")).alias("_used"))
    w = group_rank(wanted.withColumn("_s", F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))), [folder, "_s"], [F.asc(order)], "_rank")
    w = w.join(used.withColumnRenamed("_f", folder), [folder, "_s"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    open_ = F.aggregate("_used", F.col("_rank") - 1, lambda n, u: F.when(u <= n, n + 1).otherwise(n))
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return w.withColumn("free_name", F.when(open_ == 0, F.col(name)).otherwise(F.concat(base, F.lit("_dup"), open_.cast("string"), ext))).drop("_s", "_rank", "_used")


def parsed_name(file: Column, parent: Column, countries: list[str], categories: list[str] = CATEGORIES) -> Column:
    """``struct(paper_id, country, category_number, category_name)`` of a file ``Country_c-n_…``; the parent folder's name where there is no country."""
    base = F.regexp_replace(file, r"(?i)\.pdf$", "")
    named = F.regexp_extract(base, rf"^({'|'.join(countries)})_", 1)
    no = F.regexp_extract(base, rf"^(?:{'|'.join(countries)})_(\d)-\d+_", 1)
    number = F.when(no != "", no.cast("int"))
    name = F.coalesce(F.get(F.array(*map(F.lit, categories)), F.when((number >= 1) & (number <= len(categories)), number - 1)), F.lit(""))
    return F.struct(base.alias("paper_id"), F.when(named != "", named).otherwise(text(parent)).alias("country"), number.alias("category_number"), name.alias("category_name"))


def target_path(country: Column, slot: Column, title: Column) -> Column:
    """``pdfs/country/<slot, or country_unassigned>_<slug>.pdf``."""
    first = F.when(text(slot) != "", slot).otherwise(F.concat(country, F.lit("_unassigned")))
    return F.concat(F.lit("pdfs/"), country, F.lit("/"), first, F.lit("_"), slugify(title), F.lit(".pdf"))


def source_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def tally(records: DataFrame, key: str) -> DataFrame:
    """One row ``summary``: ``key=count, …`` sorted by key; ``'0'`` if there are none.  Keys are few by nature (states)."""
    c = records.groupBy(key).agg(F.count("*").alias("n"))
    return c.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit("="), F.col("n").cast("string")))), ", ").alias("summary")).select(F.when(F.col("summary") == "", "0").otherwise(F.col("summary")).alias("summary"))


def organise(records: DataFrame, files: DataFrame, taken: DataFrame, folder: str, root: str, weight: Column, skip: Column, order: str, countries: list[str], categories: list[str] = CATEGORIES) -> DataFrame:
    """The plan of a tidy copy of the records' files: ``(order, country, category, category_number, sequence, title, source_path, new_path, status, note)``.

    Only rows of ``countries`` are looked at.  ``status`` is ``skipped_rejected``
    (``skip`` holds), ``skipped_no_pdf``, ``skipped_missing_file`` (not in the
    listing ``files (path)``), ``error`` (unknown category) or ``dry_run``.
    The last are numbered in their country and category by ``weight``, title
    and order, and get a name that is free in ``taken (folder, name)`` and
    among themselves.  The copy itself is :func:`paperloom.sources.sinks.copy_files`.
    """
    named = lambda c: pick(records, c)
    r = records.select(order, named("country").alias("country"), named("category").alias("category"), named("title").alias("title"), named("local_pdf_path").alias("source_path"), weight.alias("_w"), F.coalesce(skip, F.lit(False)).alias("_skip"))
    r = r.where(F.col("country").isin(countries)).withColumn("category_number", category_number(F.col("category"), categories))
    r = r.withColumn("_src", source_path(F.col("source_path"), root))
    r = with_existence(r, files, "_src", "_there")
    status = F.when(F.col("_skip"), "skipped_rejected").when(F.col("source_path") == "", "skipped_no_pdf").when(~F.col("_there"), "skipped_missing_file").when(F.col("category_number").isNull(), "error").otherwise("dry_run")
    r = numbered(r.withColumn("status", status), ("country", "category_number"), [F.col("_w"), F.lower("title"), F.asc(order)], F.col("status") == "dry_run")
    go = r.where("sequence is not null").withColumn("_name", file_name(F.col("country"), F.col("category_number"), F.col("sequence"), F.col("title")))
    go = free_names(go, taken.select("country", F.col("name").alias("_name")), "_name", "country", order)
    go = go.withColumns({"new_path": F.concat(F.lit(folder.rstrip("/") + "/"), "country", F.lit("/"), "free_name"), "note": F.when(F.col("free_name") != F.col("_name"), F.concat(F.lit("renamed: "), "_name", F.lit(" -> "), "free_name")).otherwise("")})
    note = F.when(F.col("status") == "error", F.concat(F.lit("unknown category: "), "category")).when(F.col("status") == "skipped_missing_file", F.concat(F.lit("no file: "), "_src")).otherwise("")
    rest = r.where("sequence is null").withColumns({"new_path": F.lit(""), "note": note})
    cols = [order, "country", "category", "category_number", "sequence", "title", "source_path", "new_path", "status", "note"]
    return go.select(cols).unionByName(rest.select(cols))
