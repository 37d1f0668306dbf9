import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import history as H
from paperloom.llm.components import components
from paperloom.llm.runs import Reader, size_of, write_run
from paperloom.llm.textforms import doi_key, mistyped, same_title, title_tokens, within_one

SCHEMA = "cand_no bigint, batch_no int, id string, doi string, title string, a bigint"
TOPICS = ["Late-Career Training", "Power Distance", "Fear of Blame", "Paper Habits", "Trust Repair", "Skill Ageing", "Open Offices", "Work Effort"]
PEOPLE = ["Tour Guides", "Site Foremen", "Rice Millers", "Ward Nurses", "Call Agents", "Bank Clerks"]
PLACES = ["Airports in Japan", "Food Markets in Southern Vietnam", "Toll Roads in Northern Vietnam", "Museums in Laos"]


def typo(rnd, t):
    k = rnd.randrange(1, len(t) - 1)
    return t[:k] + rnd.choice(["", t[k] * 2, "x"]) + t[k + 1 :]


def rows(seed, n=150):
    rnd = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        if out and rnd.random() < 0.4:
            o = rnd.choice(out)
            t = o[4]
            t = t and rnd.choice([t, t.upper(), f"<i>{t}</i>", "The " + t, typo(rnd, t), t.replace(" ", " ", 1), t.replace("Training", "Ｔｒａｉｎｉｎｇ")])
            doi = rnd.choice([o[3], None, f"10.9/prep.{i}"])
        else:
            t = f"{rnd.choice(TOPICS)} and {rnd.choice(TOPICS)} among {rnd.choice(PEOPLE)} of {rnd.choice(PLACES)}: A Diary Study"
            doi = rnd.choice([None, "", f"10.90/s.{i}"])
        if rnd.random() < 0.05:
            t = rnd.choice([None, ""])
        if doi and rnd.random() < 0.3:
            doi = rnd.choice([doi.upper(), "https://doi.example/" + doi, "doi: " + doi + ".", doi.replace("/", "%2F")])
        out.append((i, 0 if i < n * 0.6 else 1 + i % 8, "x", doi, t, i))
    return out


def brute(data):
    parent = {r[0]: r[0] for r in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    tokens = {r[0]: title_tokens(r[4]) for r in data}
    distinct = {tuple(tokens[r[0]]) for r in data if tokens[r[0]] and r[1] == 0}  # words in wide use are those of the history
    common = {w for w in {w for t in distinct for w in t} if sum(w in t for t in distinct) >= max(H.COMMON_LEAST, H.COMMON_SHARE * len(distinct))}
    alike = H.Corrector(common).alike
    for x in data:
        for y in data:
            if x[0] < y[0]:
                d = doi_key(x[3])
                if (d and d == doi_key(y[3])) or same_title(tokens[x[0]], tokens[y[0]], common, alike=alike):
                    a, b = find(x[0]), find(y[0])
                    parent[max(a, b)] = min(a, b)
    return {(find(r[0]), r[0]) for r in data if r[1] >= 1 and find(r[0]) < r[0]}


@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_brute_force(spark, seed):
    data = rows(seed)
    got = {tuple(r) for r in H.repeats(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    want = brute(data)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_edge_tables(spark):
    df = spark.createDataFrame([(1, 0, None, None, None, 1), (2, 1, None, "", "", 2), (3, 1, None, None, "x" * 100_000, 3), (4, 2, None, None, "x" * 100_000, 3)], SCHEMA)
    assert {tuple(r) for r in H.repeats(df).collect()} == {(3, 4)}
    assert H.repeats(df.where("cand_no < 0")).count() == 0


def test_one_title_of_a_third(spark):
    data = [(i, int(i > 50), None, None, "One Hot Title of Many Copies" if i % 3 == 0 else f"Other {chr(97 + i % 26) * 6}{chr(97 + i // 26) * 5} matter", 1) for i in range(1, 151)]
    got = {r.cand_no: r.accepted_no for r in H.repeats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i] == 3 for i in range(51, 151) if i % 3 == 0)


def roots(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_batches_merged_and_reopened_link_as_one_batch(spark):
    data = rows(5, 90)
    c = H.canonical(spark.createDataFrame(data, SCHEMA), keep=("batch_no",))
    titles = c.where("canon is not null").groupBy("canon", "batch_no").agg(F.min("cand_no").alias("cid")).cache()
    dois = c.where("doi_key is not null").groupBy("doi_key", "batch_no").agg(F.min("cand_no").alias("cid")).cache()
    forest, links = H.HistoryForest(spark, merge_at=2), []
    for b in range(9):
        links += forest.accept(titles.where(F.col("batch_no") == b), dois.where(F.col("batch_no") == b)).collect()
        forest = H.HistoryForest(spark, forest.folder, merge_at=2)  # as another session opens it
        assert len(forest.runs) <= 2
    bulk = H.HistoryForest(spark)
    at_once = bulk.accept(titles.groupBy("canon").agg(F.min("cid").alias("cid")), dois.groupBy("doi_key").agg(F.min("cid").alias("cid"))).collect()
    same = {tuple(r) for r in titles.groupBy("canon").agg(F.min("cid").alias("a")).join(titles, "canon").select("a", F.col("cid").alias("b")).collect()}
    same |= {tuple(r) for r in dois.groupBy("doi_key").agg(F.min("cid").alias("a")).join(dois, "doi_key").select("a", F.col("cid").alias("b")).collect()}
    assert all(a < b for a, b in links) and roots(list(links) + list(same)) == roots(at_once + list(same))
    assert forest.n == titles.count() and forest.version == 9
    forest.drop()


def test_signatures_are_made_anew_when_titles_have_doubled(spark):
    base = [f"market {chr(97 + i) * 6} {chr(98 + i) * 5}" for i in range(24)]
    forest = H.HistoryForest(spark)
    frame = lambda ts, start: spark.createDataFrame([(start + i, t) for i, t in enumerate(ts)], "cid bigint, canon string")
    forest.accept(frame(["market zzzzzz"], 0))
    assert forest.common == set()
    forest.accept(frame(base, 10))
    assert forest.common == {"market"} and len(forest.runs) == 1
    assert [tuple(r) for r in forest.accept(frame(["aaaaaa bbbbb markte"], 100)).collect()] == [(10, 100)]
    assert forest.accept(frame([], 200)).count() == 0 and forest.version == 4


def test_prefixes_widen_until_the_recall_target(spark):
    assert H.prefix_depth() < H.DEPTH - 1 and H.prefix_depth(similarity=0.99) == H.DEPTH
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bcdfghjklmnpqrtvwxz") for _ in range(7))
    data, shared = [], []
    for i in range(0, 400, 2):
        w = [word() for _ in range(12)]
        v = [x[:3] + x[4:] if k < 3 else x for k, x in enumerate(w)]
        a, b = H._grams(w), H._grams(v)
        shared.append(len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())))
        data += [(i, 0, None, None, " ".join(w), 1), (i + 1, 1, None, None, " ".join(v), 1)]
    assert 0.8 < sum(shared) / len(shared) < 0.86
    df = spark.createDataFrame(data, SCHEMA)
    found = {tuple(r) for r in H.repeats(df).collect()}
    assert found <= {(i, i + 1) for i in range(0, 400, 2)} and len(found) >= 0.97 * 200
    titles = H.canonical(df).select(F.col("cand_no").alias("cid"), "canon")
    forest = H.HistoryForest(spark)
    own = H.write_run(H.forest_rows(titles, set()), forest.folder, H.TEXT_TREE + 1)
    met = H.range_search(forest._rows([own]), [own], own, H.prefix_depth())
    depths = {r.p: r.depth for r in met.where("p % 2 = 1 and r = p - 1").collect()}
    assert {6, 7, 8} == set(depths.values())


def test_a_search_reads_what_its_ranges_overlap(spark, tmp_path):
    rows = spark.range(400_000).select(F.lit(0).alias("tree"), F.xxhash64("id").alias("key"), F.col("id").alias("cid"))
    run = write_run(rows, str(tmp_path), 1)
    want = [r.key for r in rows.where("cid in (5, 70000, 399999)").orderBy("key").collect()]
    reader = Reader([run], ["cid"])
    found = sorted(int(c) for _, got, _ in reader.ranges(0, np.array(want), np.array(want)) for c in got["cid"])
    assert found == [5, 70000, 399999] and reader.read <= 3 * 400_000 // 6 and size_of(run, 0) == 400_000 and size_of(run, 1) == 0
    every = np.sort(np.array([r.key for r in rows.select("key").collect()]))
    assert sum(len(p) for p, _, _ in Reader([run], ["cid"]).ranges(0, every, every, most=1000)) == 400_000


def test_parity_keeps_every_slip_of_a_long_title(spark):
    rnd = random.Random(9)
    data = []
    for i in range(0, 40, 2):
        w = ["".join(rnd.choice("bcdfghjklmnpqrtvwxz") for _ in range(8)) for _ in range(24)]
        data += [(i, 0, None, None, " ".join(w), 1), (i + 1, 1, None, None, " ".join(x[1:] if k < 6 else x for k, x in enumerate(w)), 1)]
    found = {tuple(r) for r in H.repeats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert found <= {(i, i + 1) for i in range(0, 40, 2)} and len(found) >= 19


def test_numbered_titles_do_not_meet(spark):
    """A third of all rows follow one pattern with another number each."""
    rows = spark.range(3000).select(F.col("id").alias("cid"), F.concat(F.lit("annual of report the work "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("canon"))
    forest = H.HistoryForest(spark)
    own = write_run(H.forest_rows(rows, {"annual"}), forest.folder, H.TEXT_TREE + 1)
    assert H.range_search(forest._rows([own]), [own], own, H.prefix_depth()).count() < 300


def test_corrector():
    fix = H.Corrector({"market", "form", "from"})
    assert [fix(w) for w in ("markt", "market", "mraket", "fomr", "xyz", "12", "a" * 5000)] == ["market", "market", "market", "form", "xyz", "12", "a" * 5000]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in links[:-1] if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == want


@pytest.mark.parametrize("a,b,want", [("change", "chnage", True), ("survey", "surrvey", True), ("ii", "iii", False), ("2019", "2018", False), ("northern", "southern", False), ("island", "ialadn", True), ("vietnam", "vietnm", True)])
def test_mistyped(a, b, want):
    assert mistyped(a, b, {"change", "survey", "northern", "southern", "island", "vietnam"}) is want


def test_forms():
    assert title_tokens("The <i>Behaviour &amp; Organisation</i>") == title_tokens("organization AND behavior")
    assert title_tokens(None) == [] and doi_key("https://doi.example/10.90%2Fs.1.") == "10.90/s.1" and doi_key("none") is None
    assert within_one("abc", "acb") and within_one("abc", "abcd") and not within_one("abc", "cab")
    assert not same_title(["hotel", "retired"], ["hotel"], set()) and not same_title([], [], set())
    assert 1 <= H.prefix_depth() <= H.DEPTH
