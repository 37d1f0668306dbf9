import pytest

from paperloom.operators.split_values import resolve, split_values

CASES = [
    ("n", "A Bo; C Do", ["A Bo", "C Do"]),
    ("n", "Bo, A.;Do, C.", ["Bo, A.", "Do, C."]),
    ("n", "Bo, Aa", ["Bo, Aa"]),
    ("n", "Bo,　A.", ["Bo,　A."]),
    ("n", "Aa Bo, Cc Do and Ee Fo", ["Aa Bo", "Cc Do", "Ee Fo"]),
    ("n", "Aa Bo & Cc Do", ["Aa Bo", "Cc Do"]),
    ("n", '["Aa Bo", "Cc Do"]', ["Aa Bo", "Cc Do"]),
    ("n", '"Bo, Aa","Do, Cc"', ["Bo, Aa", "Do, Cc"]),
    ("n", "Aa Bo; Cc Do; and Ee Fo;", ["Aa Bo", "Cc Do", "Ee Fo"]),
    ("n", "Aa Bo||Cc Do|Ee Fo", ["Aa Bo", "Cc Do", "Ee Fo"]),
    ("n", "Aa Bo\nCc Do", ["Aa Bo", "Cc Do"]),
    ("n", "Faculty for Population and Family (Xy), Aa Bo", ["Faculty for Population and Family (Xy)", "Aa Bo"]),
    ("t", "3 matches: a b, c d, e f", ["a b", "c d", "e f"]),
    ("t", "0 matches: ", []),
    ("t", '"pay; rank and tenure"', ["pay; rank and tenure"]),
    ("t", "on/off shift / pilot fear", ["on/off shift", "pilot fear"]),
    ("t", "pilot fear; give and take; ;x y", ["pilot fear", "give and take", "x y"]),
    ("t", "give and take", ["give and take"]),
    ("t", "x y and pilot fear", ["x y", "pilot fear"]),
    ("t", "x y, pilot fear, and give and take", ["x y", "pilot fear", "give and take"]),
    ("t", "Laos · Hong Kong, China", ["Laos", "Hong Kong, China"]),
    ("t", "Hong Kong, China, Laos", ["Hong Kong, China", "Laos"]),
    ("t", None, []),
    ("t", "", []),
    ("t", " ; ;; ", []),
    ("t", 'an "odd quote; and more', ['an "odd quote', "more"]),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, v if k == "n" else None, v if k == "t" else None, "extra") for i, (k, v, _) in enumerate(CASES)]
    # a phrase is learned from two fields
    rows += [(1000 + i, None, v, "extra") for i, v in enumerate(["give and take; x", "Hong Kong, China; y"])]
    df = spark.createDataFrame(rows, "no int, n string, t string, val string")
    out = {}
    for r in split_values(df, "no", ("n", "t"), ("n",), single=True).orderBy("no", "pos").collect():
        assert r.pos == len(out.setdefault(r.no, [])) + 1
        out[r.no].append(r.val)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(got, i):
    assert got.get(i, []) == CASES[i][2]


def split(spark, *fields):
    rows = split_values(spark.createDataFrame(list(enumerate(fields)), "no int, t string"), "no", ("t",), single=True).orderBy("no", "pos").collect()
    return [[r.val for r in rows if r.no == i] for i in range(len(fields))]


def test_phrases_of_many_parts(spark):
    long = "a1, b1, c1, d1, e1, f1"
    assert split(spark, f"{long}; x", f"y; {long}", f"z z, {long}", f"{long}, q and r")[2:] == [["z z", long], [long, "q", "r"]]


def test_a_list_in_another_field_is_no_phrase(spark):
    once = ["Laos, Japan; Vietnam", "Laos, Japan", "Laos, Japan, Thailand"]
    assert split(spark, *once)[1:] == [["Laos", "Japan"], ["Laos", "Japan", "Thailand"]]
    # twice, but the parts are values of their own more often
    often = [*once, "Laos, Japan; Nepal", "Laos; Japan; India", "Laos; Japan", "Laos; Nepal; Japan"]
    assert split(spark, *often)[1:3] == [["Laos", "Japan"], ["Laos", "Japan", "Thailand"]]


def test_quotes_and_plain_cuts_agree(spark):
    fields = ["a b; ; c d;and e f; ", "a b , c d ,, and e f", "a b|c d| |& e f|"]
    assert split(spark, *fields) == [["a b", "c d", "e f"]] * 3
    assert split(spark, *(f.replace("a b", '"a b"') for f in fields)) == [["a b", "c d", "e f"]] * 3


def test_only_fields_with_several(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b; c d"), (2, "a b; c d")], "no int, t string")
    rows = split_values(df, "no", ("t",)).collect()
    assert len(rows) == 4 and {r.no for r in rows} == {2}


def test_long_and_empty_table(spark):
    df = spark.createDataFrame([(1, "; ".join(f"v{i} x" for i in range(5000)))], "no int, t string")
    assert split_values(df, "no", ("t",)).count() == 5000
    assert split_values(df.where("no < 0"), "no", ("t",)).count() == 0


def test_rules():
    assert resolve("NQ,Q") == "comma" and resolve("Nw,i") == "pairs" and resolve("Nf,f+f") == "comma" and resolve("Tw,w") == "comma" and resolve("Tf") == "one"
