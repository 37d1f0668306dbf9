import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import clean, dedup, grid, keywords, organize
from paperloom.operators.upsert import enrich, upsert


def test_keyword_quirks(spark):
    df = spark.createDataFrame([(1, "Employees in Thailand", None, ""), (2, None, None, None)], "n int, title string, abstract string, journal_source string").withColumns({"country": F.lit("Thailand"), "category": F.lit("x")})
    a, b = keywords.score(df).orderBy("n").collect()
    assert a.organisation_hits == ["employee", "employees"] and a.country_hits == ["Thailand", "Thai"]
    assert a.related_category == "0 matches: " and b.workplace_organization_score == 0


def fold(existing, new, locked):
    by = {}
    for r in existing:
        by[r["id"]] = dict(r)
    touched = set()
    for r in new:
        if r["id"] not in by:
            by[r["id"]] = dict(r)
            continue
        o = by[r["id"]]
        hold = o["st"] in locked
        for k, v in r.items():
            if k in ("id", "created_at") or (k == "st" and hold) or (k == "slot" and o["slot"]):
                continue
            if v:
                o[k] = v
        touched.add(r["id"])
    return by


@pytest.mark.parametrize("seed", range(3))
def test_upsert_equals_fold(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *x: rnd.choice(x)
    rows = lambda n, at: [{"id": f"k{rnd.randrange(8)}", "ord": at + i, "a": pick(None, "", "x", "y"), "n": pick(None, 0, 1, 2), "st": pick("", "open", "locked", "new"), "slot": pick("", None, "s1", "s2"), "created_at": f"t{at + i}"} for i in range(n)]
    old = {r["id"]: r for r in rows(10, 0)}.values()
    new = rows(40, 100)
    want = fold(old, [{k: v for k, v in r.items() if k != "ord"} for r in new], {"locked"})
    schema = "id string, ord int, a string, n int, st string, slot string, created_at string"
    e = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in old], schema)
    n = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in new], schema).repartition(3)
    got = {r.id: r for r in upsert(e, n, locked={"st": ["locked"]}).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c in ("a", "n", "st", "slot", "created_at"):
            assert getattr(got[k], c) == w[c], (k, c)


def test_upsert_with_nothing_new(spark):
    e = spark.createDataFrame([("a", 1, "x")], "id string, ord int, v string")
    assert [(r.id, r.v) for r in upsert(e, e.where("ord < 0")).collect()] == [("a", "x")]


def test_enrich(spark):
    r = spark.createDataFrame([(1, "10.1/A", "", "k"), (2, None, None, None), (3, "10.2", "gold", None)], "n int, doi string, oa string, extra string")
    look = spark.createDataFrame([(" 10.1/a", "green"), ("10.1/A", "hybrid"), ("10.2", "green"), ("", "x")], "doi string, oa string")
    got = {x.n: x.oa for x in enrich(r, look, "doi", {"oa": F.col("l_oa")}).collect()}
    assert got == {1: "green", 2: None, 3: "gold"}


def greedy(rows, match):
    out, originals = {}, []
    for r in rows:
        hit = [o for kind in (0, 1, 2) for o in originals if match(o, r) == kind]
        if hit:
            out[r[0]] = hit[0][0]
        else:
            out[r[0]] = None
            originals.append(r)
    return out


def python_match(a, b):
    if a[1] and a[1] == b[1]:
        return 0
    if a[2] and a[2] == b[2]:
        return 1
    if a[2] and b[2]:
        x, y = " ".join(sorted(a[2].split())), " ".join(sorted(b[2].split()))
        if 100 * dedup.indel(x, y) <= 8 * (len(x) + len(y)):
            return 2
    return None


@pytest.mark.parametrize("seed", range(3))
def test_deduplicate_equals_greedy(spark, seed):
    rnd = random.Random(seed)
    words = ["age", "label", "work", "value", "team", "talk", "labels", "worth", "tale", "teams"]
    rows = []
    for i in range(60):
        t = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 4, 5, 5])))
        if t and rnd.random() < 0.4:
            k = rnd.randrange(len(t))
            t = " ".join((t[:k] + rnd.choice("xyz") + t[k + 1 :]).split())
        rows.append((i, rnd.choice(["", None, f"10.1/{rnd.randrange(25)}"]), t))
    df = spark.createDataFrame(rows, "ord int, doi string, title string").repartition(3)
    got = {r.ord: r.duplicate_of for r in dedup.deduplicate(df).collect()}
    assert got == greedy(rows, python_match)


def test_duplicate_never_leads(spark):
    df = spark.createDataFrame([(1, "10.1/a", "one title here"), (2, "10.1/a", "quite another one"), (3, "", "quite another one")], "ord int, doi string, title string")
    assert {r.ord: r.duplicate_of for r in dedup.deduplicate(df).collect()} == {1: None, 2: 1, 3: None}
    assert dedup.deduplicate(df.where("ord < 0")).count() == 0


def test_similar_pairs_of_titles_of_the_same_phrases(spark):
    """No pair is a row before it is known to be similar, and every similar one is found at any length."""
    rnd = random.Random(4)
    phrases = ["age labels", "work values", "peer trust", "shift loyalty", "open offices", "rural japan", "a diary study", "tea estates", "\U0001f600 é"]
    s = {" ".join(rnd.choice(phrases) for _ in range(rnd.choice([1, 6, 8]))) for _ in range(250)} | {"a", "ab", "abc", "abcdef", "abxcdef", "aaaaaaaaaaaaaaaaaaaaaaaaaa"}
    long = "".join(rnd.choice("abcdefgh ") for _ in range(700))
    s |= {long, "z" * 55 + long[:650], "z" * 60 + long[:640], long[:350] + long[450:], long * 2, long * 2 + "q" * 110, long * 2 + "q" * 125}
    data = list(enumerate(sorted(s)))
    found = dedup.similar_pairs(spark.createDataFrame(data, "o bigint, s string").repartition(3))
    got = [tuple(r) for r in found.collect()]
    want = {(a, b) for a, x in data for b, y in data if a < b and 100 * dedup.indel(x, y) <= 8 * (len(x) + len(y))}
    assert len(got) == len(set(got)) and set(got) == want and any(len(data[a][1]) > 600 for a, _ in want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_indel():
    assert dedup.indel("lewenstein", "levenshtein") == 3 and dedup.indel("", "ab") == 2


def test_places(spark):
    c = spark.createDataFrame([(1, "Thailand", "Work Values / Work Ethic", "Thailand_1-2", 5), (2, "Thailand", "Work Values / Work Ethic", "", 3), (3, "Thailand", "Work Values / Work Ethic", None, 9), (4, "Japan", "Work Values / Work Ethic", None, 1)], "n int, country string, category string, slot string, score int")
    got = {r.n: r.new_slot for r in grid.fill_places(c, grid.grid(spark), [F.desc("score"), F.asc("n")], F.lit(True)).collect()}
    assert got == {3: "Thailand_2-2", 4: "Japan_1-2"}
    assert grid.open_places(grid.grid(spark), c, F.col("score") > 4).count() == 35


@pytest.mark.parametrize(
    "line,heading,junk",
    [
        ("1. Introduction", "keep", None), ("Introduction", None, None), ("References", "drop", None), ("2.1 Methods", "methods", None), ("Results showed that", "keep", None), ("doi: 10.1234/abc", None, "doi"),
        ("https://x.example/a", None, "url"), ("Page 12", None, "page"), ("mail a@b.org", None, "email"), ("University of X", None, "affil"), ("we found p < .05 here", None, "stat"), ("1.2 3.4 5.6 7", None, "table"), ("", None, None),
    ],
)
def test_line_classes(spark, line, heading, junk):
    r = spark.createDataFrame([(line,)], "x string").select(clean.heading_class(F.col("x")).alias("h"), clean.junk_class(F.col("x")).alias("j")).first()
    assert (r.h, r.j) == (heading, junk)


def test_clean(spark):
    t = "Title line of this paper is a long one with more than eight words in it\n\n2. Findings\nfirst exam-\nple line\n12\nsecond line\n\nthird\nReferences\nDoe, J. (2020) Some work\n“a quotation that is long enough to stay”"
    a, b, c = clean.clean_documents(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert a.cleaned == "Title line of this paper is a long one with more than eight words in it\n\nfirst example line second line\n\nthird\n\n“a quotation that is long enough to stay”"
    assert a.kept_sections == ["2. Findings"] and a.removed_sections == ["References"] and a.warnings == ["qualitative quotes retained", "references removed"]
    assert b.cleaned == c.cleaned == "" and len(b.warnings) == 1


def test_notes(spark):
    e = F.array().cast("array<string>")
    got = spark.range(1).select(clean.notes({"paper_id": F.lit("p")}, F.array(F.lit("a")), e, e, {"word_count_raw": F.lit(3)}).alias("n")).first().n
    assert got == "paper_id: p\n\nkept_sections:\n- a\n\nremoved_sections:\n- (none detected)\n\nwarnings:\n- (none)\n\nword_count_raw: 3"


def test_names(spark):
    w = spark.createDataFrame([(1, "f", "A.pdf"), (2, "f", "a.pdf"), (3, "g", "A.pdf"), (4, "f", "b.pdf")], "ord int, folder string, name string")
    taken = spark.createDataFrame([("f", "a_dup1.pdf"), ("f", "A.PDF")], "folder string, name string")
    got = {r.ord: r.free_name for r in organize.free_names(w, taken).collect()}
    assert got == {1: "A_dup2.pdf", 2: "a_dup3.pdf", 3: "A.pdf", 4: "b.pdf"}


def test_parsed_name(spark):
    r = spark.range(1).select(organize.parsed_name(F.lit("Vietnam_4-1_x.pdf"), F.lit("p"), ["Vietnam"]).alias("m")).select("m.*").first()
    assert tuple(r) == ("Vietnam_4-1_x", "Vietnam", 4, "Communication / Psychological Safety")
    r = spark.range(1).select(organize.parsed_name(F.lit("other.pdf"), F.lit("p"), ["Vietnam"]).alias("m")).select("m.*").first()
    assert tuple(r) == ("other", "p", None, "")


def test_numbering_and_tally(spark):
    df = spark.createDataFrame([(1, "x", "b"), (2, "x", None), (3, "x", "a"), (4, "y", "c")], "n int, g string, t string")
    got = {r.n: r.sequence for r in organize.numbered(df, ("g",), [F.asc("t")], F.col("t").isNotNull()).collect()}
    assert got == {1: 2, 2: None, 3: 1, 4: 1}
    assert organize.tally(df, "g").first().summary == "x=3, y=1" and organize.tally(df.where("n < 0"), "g").first().summary == "0"


def test_group_rank(spark):
    from paperloom.operators.ranks import group_rank

    rnd = random.Random(1)
    data = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randrange(50)) for i in range(2000)]
    got = {r.n: r.rank for r in group_rank(spark.createDataFrame(data, "n int, g string, v int").repartition(5), ["g"], [F.desc("v"), F.asc("n")]).collect()}
    want = {}
    for g in {d[1] for d in data}:
        for k, d in enumerate(sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0])), 1):
            want[d[0]] = k
    assert got == want


def test_category_spellings(spark):
    got = spark.createDataFrame([(c,) for c in ("Stereotypes / Ageism", " stereotypes / AGEISM ", " 2 x", "7 x", "23", "unknown", "", None)], "c string").select(organize.category_number(F.col("c")).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 2, None, None, None, None, None]


def test_organise(spark):
    rows = [(1, "Japan", "Stereotypes / Ageism", "One", "/a.pdf", 0), (2, "Japan", "Stereotypes / Ageism", "Two", "/a.pdf", 1), (3, "Japan", "x", "T", "/a.pdf", 0), (4, "Japan", "1 x", "T", "/none.pdf", 0), (5, "Japan", "1 x", None, None, 0), (6, "Japan", "1 x", "T", "/a.pdf", 9), (7, "Laos", "1 x", "T", "/a.pdf", 0)]
    r = spark.createDataFrame([(*x, "extra") for x in rows], "cand_no int, country string, category string, title string, local_pdf_path string, w int, note string")
    there, taken = spark.createDataFrame([("/a.pdf",)], "path string"), spark.createDataFrame([("Japan", "JAPAN_1-1_one.pdf")], "country string, name string")
    got = {x.cand_no: x for x in organize.organise(r, there, taken, "/out/", "/d", F.col("w"), F.col("w") == 9, "cand_no", ["Japan"]).collect()}
    assert {k: v.status for k, v in got.items()} == {1: "dry_run", 2: "dry_run", 3: "error", 4: "skipped_missing_file", 5: "skipped_no_pdf", 6: "skipped_rejected"}
    assert (got[1].new_path, got[1].note, got[2].new_path, got[2].sequence) == ("/out/Japan/Japan_1-1_one_dup1.pdf", "renamed: Japan_1-1_one.pdf -> Japan_1-1_one_dup1.pdf", "/out/Japan/Japan_1-2_two.pdf", 2)
    assert organize.organise(r.where("cand_no < 0"), there, taken, "/out", "/d", F.col("w"), F.lit(False), "cand_no", ["Japan"]).count() == 0


def test_states_weights_and_workplace(spark):
    t = spark.createDataFrame([("", 1, False), ("few words", 1, False), ("few words " + "x" * 90, 1, False), ("w " * 100, 1, False), ("w " * 100, 1, True)], "t string, p int, bad boolean")
    assert [r.s for r in t.select(clean.text_state(F.col("t"), F.col("p"), F.col("bad")).alias("s")).collect()] == ["no_text", "short_scanned", "short", "text", "error"]
    w = spark.createDataFrame([("a",), ("z",), (None,)], "v string").select(grid.weighted(F.col("v"), {"a": 4}, 1).alias("w"))
    assert [r.w for r in w.collect()] == [4, 1, 1]
    from paperloom.operators.keywords import workplace

    r = workplace(spark.createDataFrame([("Employee voice", None, None), (None, None, None)], "title string, abstract string, journal_source string")).collect()
    assert (r[0].in_workplace, r[1].in_workplace, r[1].workplace_hits) == (True, False, [])


def test_short_titles_are_compared_exactly(spark):
    from paperloom.operators.dedup import indel, similar_pairs

    rnd = random.Random(8)
    base = ["abcdef", "abxcdef", "abcdefg", "abcde", "abcd", "bcdefg", "aaaaaa", "aaaaaaa", "a" * 30, "a" * 31, "a" * 33]
    for n in (6, 7, 8, 9, 12, 20, 29, 40):
        for _ in range(6):
            s = "".join(rnd.choice("abcd ") for _ in range(n)).strip() or "q"
            base += [s, s[:2] + s[3:], s[:3] + "z" + s[3:], s + "zz"]
    titles = sorted(set(base))
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(list(enumerate(titles)), "o bigint, s string")).collect()}
    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if i < j and 100 * indel(x, y) <= 8 * (len(x) + len(y))}
    assert got == want and (titles.index("abcdef"), titles.index("abxcdef")) in got


def test_long_chain_of_duplicates(spark):
    """Neighbours share a DOI or a title in turn: every second row is an original."""
    rows = [(i, f"10.9/{i // 2}", f"title number {(i + 1) // 2} of the chain") for i in range(150)]
    got = {r.ord: r.duplicate_of for r in dedup.deduplicate(spark.createDataFrame(rows, "ord bigint, doi string, title string"), fuzzy=False).collect()}
    assert got == {i: None if i % 2 == 0 else i - 1 for i in range(150)}
