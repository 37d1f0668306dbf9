import random

from paperloom.llm import neardup as N
from paperloom.llm.history import Corrector
from paperloom.llm.textforms import same_title, text_words, title_tokens
from paperloom.session import materialise

SCHEMA = "cand_no bigint, title string, abstract string, a string, rep string"
WORDS = [f"{a}{b}" for a in ("lan", "mor", "tis", "vek", "dol", "han", "pri", "sul") for b in ("ta", "re", "mi", "on", "ed", "ing", "or", "al", "ver", "ux")]


def rows(seed, n=160):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.5:
            _, t, a, _, _ = rnd.choice(out)
            if t and a:
                w = a.split()
                for _ in range(rnd.choice([0, 1, 3, 6, 10])):
                    k = rnd.randrange(len(w))
                    w[k : k + 1] = rnd.choice([[], ["clearly", w[k]], [w[k] + "x"]])
                a = " ".join(w)
                t = rnd.choice([t, t.upper(), "The " + t, t.replace("e", "ee", 1), t + " II"])
        else:
            t = " ".join(rnd.sample(WORDS, 9)).title()
            a = " ".join(rnd.choice(WORDS) for _ in range(90))
        if rnd.random() < 0.05:
            a = rnd.choice([None, ""])
        out.append((i, t, a, "x", "y"))
    return out


def brute(data):
    forms = [(r[0], title_tokens(r[1]), text_words(r[2])) for r in data if r[1] and r[2]]
    distinct = {tuple(t) for _, t, _ in forms}
    common = {w for t in distinct for w in t if sum(w in u for u in distinct) >= max(20, 0.0005 * len(distinct))}
    alike = Corrector(common).alike
    return {(x[0], y[0]) for i, x in enumerate(forms) for y in forms[i + 1 :] if same_title(x[1], y[1], common, alike=alike) and N.shared(x[2], y[2]) >= N.SIMILARITY}


def test_pairs_against_brute_force(spark):
    found = wanted = 0
    for seed in range(2):
        data = rows(seed)
        got = [tuple(r) for r in N.row_pairs(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()]
        want = brute(data)
        assert len(got) == len(set(got)) and set(got) <= want
        found, wanted = found + len(got), wanted + len(want)
    assert wanted > 100 and found >= 0.99 * wanted


def test_groups_and_edges(spark):
    df = spark.createDataFrame([(1, "A b c", "x y z", "", ""), (2, "a b C", "<p>X y z</p>", "", ""), (3, None, "x", "", ""), (4, "t", None, "", ""), (5, "", "", "", "")], SCHEMA)
    assert {(r.cand_no, r.group_no, r.n_links) for r in N.groups(df).collect()} == {(1, 1, 0), (2, 1, 0)}
    assert N.row_pairs(df.where("cand_no < 0")).count() == 0
    assert N.shared([], []) == 0


def test_copies_stay_linear(spark):
    df = spark.createDataFrame([(i, "One Hot Title", "the same words over and over", "", "") for i in range(300)] + [(900, "Other", "words of its own", "", "")], SCHEMA)
    members, links = N.near_duplicates(df)
    assert members.count() == 301 and links.count() == 0


def test_long_text(spark):
    a = " ".join(f"w{i % 997}" for i in range(60_000))
    df = spark.createDataFrame([(1, "A title here", a, "", ""), (2, "A title here", a + " tail", "", "")], SCHEMA)
    assert {tuple(r) for r in N.row_pairs(df).collect()} == {(1, 2)}


def test_order_is_free(spark):
    """Abstracts put together anew from chunks of two or three words have all their words in common."""
    rnd = random.Random(3)
    data = []
    for i in range(120):
        t, w = " ".join(rnd.sample(WORDS, 9)), [rnd.choice(WORDS) for _ in range(90)]
        size = 2 + i % 2
        chunks = [w[k : k + size] for k in range(0, 90, size)]
        rnd.shuffle(chunks)
        data += [(2 * i, t, " ".join(w), "", ""), (2 * i + 1, t.title(), " ".join(x for c in chunks for x in c) + (" tail" if i % 5 else ""), "", "")]
    got = {tuple(r) for r in N.row_pairs(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(120)}


def test_one_abstract_under_many_titles_makes_no_pairs(spark):
    """A boilerplate abstract stands under many different titles, some of them twice with a small edit."""
    text = " ".join(WORDS[:60])
    data = [(i, f"{WORDS[i % 80]} {chr(97 + i % 26) * 5} {WORDS[i // 80]} {chr(97 + i // 26) * 7}", text, "", "") for i in range(1500)]
    data += [(5000 + i, data[i][1].upper(), text + " tail", "", "") for i in range(20)]
    reps = N.classes(spark.createDataFrame(data, SCHEMA))
    like, _ = N.title_classes(reps)
    assert 20 <= N.ring_pairs(reps.join(like, "no")).count() < 50  # some titles are slips of one another
    assert {tuple(r) for r in N.row_pairs(spark.createDataFrame(data, SCHEMA)).collect()} >= {(i, 5000 + i) for i in range(20)}


def test_two_slips_of_one_word(spark):
    a = " ".join(WORDS[:30])
    data = [(i, f"cutters of {chr(97 + i) * 6} {chr(98 + i) * 5}", a, "", "") for i in range(24)]
    data += [(100, "cuttnrs of the qqaabb zzyyxx", a, "", ""), (101, "Cutterrs of the qqaabb zzyyxx", a + " x", "", "")]
    assert {tuple(r) for r in N.row_pairs(spark.createDataFrame(data, SCHEMA)).collect()} == {(100, 101)}


def test_only_records_of_like_titles_are_stored_with_their_texts(spark, monkeypatch):
    """One title in fifty is met by another; the texts of the others are not written or shuffled."""
    data = [(i, " ".join([*random.Random(i).sample(WORDS, 6), f"no{i}"]), " ".join(random.Random(i).sample(WORDS, 30)), "", "") for i in range(200)]
    data += [(500 + i, data[i][1].upper(), data[i][2] + " tail", "", "") for i in range(4)]
    held = {}

    def spy(df, name="t"):
        out = materialise(df, name)
        held[name] = out.count() if "words" in out.columns or "abstract" in out.columns else 0
        return out

    monkeypatch.setattr(N, "materialise", spy)
    assert {tuple(r) for r in N.row_pairs(spark.createDataFrame(data, SCHEMA)).collect()} == {(i, 500 + i) for i in range(4)}
    assert held["wanted"] == sum(held.values()) == 8
