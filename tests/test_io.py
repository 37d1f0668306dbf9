import json

import pytest
from pyspark.sql import functions as F

from paperloom import schema
from paperloom.sources import files, payloads, sinks
from paperloom.streaming.upsert import latest, stream_upsert, windowed_counts


def test_inverted_index(spark):
    r = spark.sql("""select map('b', array(1, 3), 'a', array(0, 2)) m, cast(null as map<string, array<int>>) n""")
    assert tuple(r.select(payloads.abstract_from_index("m"), payloads.abstract_from_index("n")).first()) == ("a b a b", "")
    t = spark.createDataFrame([("x y  x",), ("",), (None,)], "t string")
    assert [x.r for x in t.select(payloads.abstract_from_index(payloads.inverted_index("t")).alias("r")).collect()] == ["x y x", "", ""]


def test_payloads(spark, tmp_path):
    work = {"id": "w1", "doi": "https://doi.org/10.1/x", "display_name": "T", "publication_year": 2020, "authorships": [{"author": {"display_name": "A B"}}, {"author": {"display_name": ""}}], "best_oa_location": {"pdf_url": "u", "license": None}, "open_access": {"is_oa": True}}
    (tmp_path / "w.json").write_text(json.dumps(work) + "\n{broken\n")
    a = payloads.works(files.read_json(spark, str(tmp_path / "w.json"), schema.WORK)).where("doi <> ''").first()
    assert (a.doi, a.title, a.authors, a.url, a.oa_source, a.is_oa, a.abstract) == ("10.1/x", "T", "A B", "w1", "openalex:oa", True, "")
    item = {"title": ["T"], "author": [{"given": "G", "family": "F"}, {"family": "X"}, {}], "DOI": "d", "issued": {"date-parts": [[2019, 1]]}, "published-print": {"date-parts": [[None]]}, "abstract": "<jats:p>z</jats:p>"}
    (tmp_path / "i.json").write_text(json.dumps(item))
    b = payloads.items(files.read_json(spark, str(tmp_path / "i.json"), schema.ITEM)).first()
    assert (b.authors, b.year, b.abstract, b.journal_source) == ("G F; X", None, "z", "")
    paper = {"paperId": "p", "title": None, "authors": [{"name": "A"}, {"name": None}], "isOpenAccess": True}
    (tmp_path / "p.json").write_text(json.dumps(paper))
    c = payloads.papers(files.read_json(spark, str(tmp_path / "p.json"), schema.PAPER)).first()
    assert (c.authors, c.oa_status, c.title, c.url[-2:]) == ("A; ", "open", "", "/p")
    look = spark.createDataFrame([("d", None, None, None)], schema.LOOKUP)
    assert tuple(payloads.lookup(look).first()) == ("d", False, "", "", "", "")


def test_state_and_csv(spark, tmp_path):
    assert files.read_state(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "s.json").write_text('[{"id": "a", "year": ""}, {"id": "b", "year": 3}]')
    assert files.read_state(spark, str(tmp_path / "s.json"), "id string, year int").count() == 2
    (tmp_path / "t.json").write_text("{[broken")
    assert files.read_state(spark, str(tmp_path / "t.json"), "id string, year int").count() == 0
    df = spark.createDataFrame([("1", 'quote " and\nline', None)], "id string, title string, doi string")
    sinks.write_csv(sinks.fixed_columns(df, ["id", "title", "doi", "more"]), str(tmp_path / "c"), single=True)
    assert tuple(files.read_csv(spark, str(tmp_path / "c")).na.fill("").first()) == ("1", 'quote " and\nline', "", "")
    assert files.first_there(spark, "", str(tmp_path / "no"), str(tmp_path / "c")) == str(tmp_path / "c")


def test_export_and_files(spark, tmp_path):
    cols = {c: F.lit("") for c in sinks.REVIEW_COLUMNS + sinks.DUPLICATE_COLUMNS}
    df = spark.range(3).select(F.col("id").alias("ord")).withColumns(cols).withColumns({"id": F.col("ord").cast("string"), "duplicate_of": F.when(F.col("ord") == 2, "1").otherwise("")})
    sinks.export_all(df, str(tmp_path / "out"), F.col("duplicate_of") == "", spark.createDataFrame([("s",)], "slot string"), "ord")
    assert files.read_csv(spark, str(tmp_path / "out/candidate_table.csv")).count() == 2
    assert files.read_csv(spark, str(tmp_path / "out/duplicates.csv")).first().duplicate_of == "1"
    w = spark.createDataFrame([("a/x.pdf", "hello"), ("b/y.pdf", None), ("b/z.pdf", "more")], "p string, c string")
    assert {r.path: r.bytes for r in sinks.write_texts(w, str(tmp_path / "t"), "p", "c").collect()} == {"a/x.pdf": 5, "b/y.pdf": 0, "b/z.pdf": 4}
    assert {(r.folder, r.name) for r in files.list_files(spark, str(tmp_path / "t")).collect()} == {("a", "x.pdf"), ("b", "y.pdf"), ("b", "z.pdf")}
    assert all(r.text == "" and r.pages == 0 for r in files.pdf_texts(spark, str(tmp_path / "t")).collect())
    plan = spark.createDataFrame([(str(tmp_path / "t/a/x.pdf"), str(tmp_path / "u/x.pdf")), ("/none", str(tmp_path / "u/z"))], "src string, dst string")
    assert {r.status for r in sinks.copy_files(plan).collect()} == {"dry_run"}
    assert sorted(r.status[:6] for r in sinks.copy_files(plan, dry_run=False).collect()) == ["copied", "error:"]
    assert sorted(r.status[:6] for r in sinks.copy_files(plan, dry_run=False).collect()) == ["error:", "exists"]  # never overwritten


@pytest.fixture
def server():
    """A local interface: search pages, one lookup, a PDF, a short one, a page, a redirect and refusals."""
    import http.server
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, dict(self.headers)))
            name = self.path.split("?")[0]
            bodies = {"/search": json.dumps({"message": {"items": [{"title": [f"t{i}"]} for i in range(5)]}}).encode(), "/doi/a%2Fb": b'{"is_oa": true}', "/x.pdf": b"%PDF-1.7" + b"x" * 20_000, "/small.pdf": b"%PDF", "/page": b"<html>login</html>"}
            if name == "/moved":
                self.send_response(302)
                self.send_header("Location", "/x.pdf")
                self.end_headers()
                return
            self.send_response(200 if name in bodies else 403)
            self.send_header("Content-Type", "text/html" if name == "/page" else "application/octet-stream")
            self.end_headers()
            self.wfile.write(bodies.get(name, b""))

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


def test_search_source(spark, server):
    from paperloom.sources.search import search

    url, asked = server
    found = search(spark, ["a b", "bad/", "c"], schema.ITEM, interface="items", url=url + "/search?q={query}&n={limit}&m={mailto}&f={fields}", limit=500, most=3, mailto="me@x.org", fields="title", headers='{"x-api-key": "k"}')
    got = found.orderBy("query_ord", "pos").select("query_ord", "pos", F.col("record.title")[0].alias("t")).collect()
    assert [tuple(r) for r in got] == [(q, i, f"t{i}") for q in (0, 1, 2) for i in range(3)]
    paths = {p for p, _ in asked}
    assert "/search?q=a%20b&n=3&m=me%40x.org&f=title" in paths and all({k.lower(): v for k, v in h.items()}["x-api-key"] == "k" for _, h in asked)
    assert search(spark, ["x"], schema.ITEM, interface="items", url=url + "/none").count() == 0
    one = search(spark, ["a%2Fb", "none"], schema.LOOKUP, interface="lookup", url=url + "/doi/{query}").orderBy("query_ord").select("record.is_oa").collect()
    assert [r.is_oa for r in one] == [None, None]  # the sign is quoted once more, so neither is there
    assert search(spark, [], schema.ITEM, interface="works").count() == 0


def test_cells_and_collect(spark):
    from paperloom.plans.pipeline import collect
    from paperloom.sources.search import cell_queries

    places = spark.createDataFrame([("Japan", "c"), ("Japan", "d"), ("Laos", "c"), ("Japan", "c")], "country string, category string")
    got = cell_queries(spark, places, {"Laos": {}, "Japan": {"c": ["q1", "q2"], "d": []}}).orderBy("query_ord").collect()
    assert [(r.country, r.category, r.query_ord, r.query) for r in got] == [("Japan", "c", 0, "q1"), ("Japan", "c", 1, "q2")]
    found = spark.createDataFrame([("Japan", "x", "10.1/A", "T in Tokyo", None, None, "", "old"), ("Japan", "x", None, None, None, None, None, None)], "country string, category string, doi string, title string, abstract string, journal_source string, pdf_url string, created_at string")
    found = found.withColumns({"oa_status": F.lit(""), "license": F.lit(None).cast("string"), "oa_source": F.lit("")})
    look = spark.createDataFrame([("10.1/a", True, "gold", "u", "by", None)], "doi string, is_oa boolean, oa_status string, pdf_url string, license string, host_type string")
    a, b = collect(found, F.lit("now"), look).orderBy(F.desc("doi")).collect()
    assert (a.id, a.pdf_url, a.oa_source, a.license, a.country_score, a.created_at, a.updated_at, a.slot) == ("doi:10.1/a", "u", "lookup:oa", "by", 1, "old", "now", "")
    assert b.id.startswith("raw:") and b.created_at == "now"


def test_looked_up(spark):
    c = spark.createDataFrame([(1, " 10.1/A "), (2, "none"), (3, None)], "n int, doi string")
    raw = spark.createDataFrame([("10.1/a", True, None, ("u", None, "repo"))], schema.LOOKUP)
    got = {r.n: (r.l_is_oa, r.l_pdf_url, r.l_host_type) for r in payloads.looked_up(c, raw).collect()}
    assert got == {1: (True, "u", "repo"), 2: (False, "", ""), 3: (False, "", "")}


def test_fetch_and_save(spark, server, tmp_path):
    from paperloom.sources.fetch import fetch, save_pdfs

    url, _ = server
    names = ["x.pdf", "small.pdf", "page", "moved", "no"]
    df = spark.createDataFrame([(f"{url}/{n}",) for n in names] + [(None,), ("http://127.0.0.1:9/x",)], "url string")
    landed = fetch(df).cache()
    got = {r.url.rsplit("/", 1)[1]: (r.code, r.size, r.error is None) for r in landed.where("url not like '%:9/%'").collect()}
    assert got == {"x.pdf": (200, 20008, True), "small.pdf": (200, 4, True), "page": (200, 18, True), "moved": (200, 20008, True), "no": (403, 0, True)}
    assert landed.where("error is not null and code is null").count() == 1 and landed.where("final_url like '%x.pdf' and url like '%moved'").count() == 1
    plan = landed.withColumn("path", F.concat(F.lit("d/"), F.element_at(F.split("url", "/"), -1)))
    saved = {r.path: r.status for r in save_pdfs(plan.where("url not like '%:9/%'"), str(tmp_path / "pdfs")).collect()}
    assert saved == {"d/x.pdf": "saved", "d/small.pdf": "too_small", "d/page": "not_pdf", "d/moved": "saved", "d/no": "not_pdf"}
    assert (tmp_path / "pdfs/d/x.pdf").stat().st_size == 20008 and not (tmp_path / "pdfs/d/small.pdf").exists()


def test_listing(spark, tmp_path):
    for p in ("Japan/b.pdf", "Japan/a.pdf", "Japan/x.txt", "Laos/c.PDF", "Laos/d.pdf"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"" if "b." in p else b"x")
    got = files.list_files(spark, [str(tmp_path / c) for c in ("Japan", "Laos", "none")]).collect()
    assert {(r.folder, r.name, r.bytes) for r in got} == {("Japan", "b.pdf", 0), ("Japan", "a.pdf", 1), ("Laos", "d.pdf", 1)}
    assert [r.name for r in files.collect_pdfs(spark, str(tmp_path), ["Laos", "Japan"]).collect()] == ["d.pdf", "a.pdf", "b.pdf"]
    one = str(tmp_path / "Laos/c.PDF")
    assert [r.path for r in files.collect_pdfs(spark, str(tmp_path), [], one).collect()] == [one]
    assert files.collect_pdfs(spark, str(tmp_path), [], str(tmp_path / "Japan/x.txt")).count() == files.collect_pdfs(spark, str(tmp_path), [], one + "x.pdf").count() == 0
    there = files.with_existence(spark.createDataFrame([(one, 5), ("/no", 5), (None, 5)], "path string, there int"), files.collect_pdfs(spark, str(tmp_path), [], one))
    assert {(r.path, r.there) for r in there.collect()} == {(one, True), ("/no", False), (None, False)}


def test_logs_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü", None), (1, 'a"b', "x")], "n int, title string, doi string")
    sinks.write_json_array(df, str(tmp_path / "j"), "n")
    (text,) = [p.read_text() for p in (tmp_path / "j").glob("*.txt")]
    assert json.loads(text) == [{"n": 1, "title": 'a"b', "doi": "x"}, {"n": 2, "title": "ü", "doi": None}] and "ü" in text and text.startswith("[\n  {\n    ")
    sinks.write_json_array(df.where("n > 5"), str(tmp_path / "e"), "n")
    assert json.loads(next((tmp_path / "e").glob("*.txt")).read_text()) == []
    sinks.write_log(df, str(tmp_path / "l"), sinks.RENAME_COLUMNS)
    assert files.read_csv(spark, str(tmp_path / "l")).columns == sinks.RENAME_COLUMNS
    sinks.write_log(df, str(tmp_path / "p"), sinks.PREPROCESS_COLUMNS)
    log = sinks.download_log(spark.createDataFrame([(1, "old", None), (2, "old", "u")], "cand_no int, local_pdf_path string, pdf_url string").withColumns({c: F.lit("") for c in ("country", "category", "title", "doi", "oa_status", "license")}), F.lit("h"), F.lit("s"), F.lit(None).cast("string"), F.when(F.col("cand_no") == 2, "new"))
    assert log.columns == ["cand_no", *sinks.DOWNLOAD_COLUMNS] and [r.local_pdf_path for r in log.orderBy("cand_no").collect()] == ["old", "new"]


def test_rule_files(tmp_path):
    from paperloom import rules

    (tmp_path / "k.yml").write_text("B:\n  index: 2\n  keywords: [x]\nA:\n  index: 1\n  keywords:\n    - y\n    - ü\n")
    (tmp_path / "c.yml").write_text("Laos: [Laos]\nNepal:\n")
    (tmp_path / "r.yml").write_text("workplace_keywords: [w]\norganizational_keywords: [o]\nscoring:\n  org_context_min: 2\n")
    (tmp_path / "q.yml").write_text("Laos:\n  A: [q one, q two]\n  B:\nNepal:\n")
    assert list(rules.load_category_words(str(tmp_path / "k.yml")).items()) == [("A", ["y", "ü"]), ("B", ["x"])]
    assert rules.load_queries(str(tmp_path / "q.yml")) == {"Laos": {"A": ["q one", "q two"], "B": []}, "Nepal": {}}
    w = rules.load_words(str(tmp_path / "c.yml"), str(tmp_path / "k.yml"), str(tmp_path / "r.yml"))
    assert w.country == {"Laos": ["Laos"], "Nepal": []} and w.organisation == ["o"] and w.medical == rules.MEDICAL_WORDS
    assert rules.load_words().category == rules.CATEGORY_WORDS and sum(len(q) for c in rules.QUERIES.values() for q in c.values()) == 54


def test_stdin_to_stdout(spark):
    import io

    from paperloom.__main__ import main

    out = io.StringIO()
    main(io.StringIO(json.dumps([{"id": "a", "title": "One title of a study"}, {"id": "b", "title": "One title of a  STUDY"}, {"id": "c"}])), out)
    got = json.loads(out.getvalue())
    assert [r.get("duplicate_of") for r in got] == [None, "a", None] and got[1]["screening_status"] == "duplicate"


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    schema_ = "id string, ord int, v string, screening_status string"
    for n, rows in enumerate([[("a", 1, "x", "open"), ("b", 2, "", "")], [("a", 3, "y", "new"), ("b", 4, "z", "held")], [("b", 5, None, "late")]]):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(src)
        q = stream_upsert(spark.readStream.schema(schema_).parquet(src), str(tmp_path / "state"), str(tmp_path / "cp"), locked={"screening_status": ["held"]}).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.id: (r.v, r.screening_status) for r in spark.read.parquet(latest(spark, str(tmp_path / "state"))).collect()}
    assert got == {"a": ("y", "new"), "b": ("z", "held")}
    assert windowed_counts(spark.readStream.format("rate").load(), "timestamp", "value").isStreaming


@pytest.mark.parametrize("name", ["p3_found", "title_forms", "places_filled", "upserted", "documents_cleaned"])
def test_entry(spark, name):
    import os

    import __spark_entry__ as E

    if not os.path.isdir(E.SMOKE):
        pytest.skip("no test tables")
    df = E.queries()[name](spark, E.SMOKE)
    assert df.count() > 0 and df.columns
