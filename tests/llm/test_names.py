import random
from itertools import combinations

import pytest

from paperloom.llm import names as N

GROUPS = [
    ["Pásermel Rírcalnula", "RÍRCALNULA, Pásermel", "P. Rírcalnula", "Rírcalnula P", "Pasermel Rircalnula", "Pásermel (Pás) Rírcalnula", "Pásermel N. Rírcalnula", "Pásremel Rírcalnula", "Pás Rírcalnula", "Ｐásermel Rírcalnula", "Páser​mel Rírcalnula"],
    ["Gusho Harbofela", "Harbofela, G."],
    ["Tokhu Harbofela", "T. Harbofela"],
    ["Institute for Ageing and Work, Kiderzemelshir University", "Inst. for Age. & Work, Kiderzemelshir Univ.", "Kiderzemelshir University, Institute for Ageing and Work", "Kiderzemelshir University Institute of Ageing and Work", "Institute for Ageing and Work (Kiderzemelshir)", "Institute for Ageing and Work, Kiderzemelshr University"],
    ["Institute for Skills Research, Kiderzemelshir University", "Inst. for Skills Res., Kiderzemelshir Univ."],
    ["Institute for Skills Research, Molildateshir University", "Institute for Ageing Matters, Molildateshir University"][:1],
    ["Solo"],
]


def test_variants(spark):
    values = [v for g in GROUPS for v in g]
    df = spark.createDataFrame([(v, "k") for v in values * 3] + [(None, ""), ("", "")], "val string, form_id string")
    got = [tuple(r) for r in N.variant_pairs(df).collect()]
    want = {tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_ambiguous_initial(spark):
    df = spark.createDataFrame([("Anna Wekhulpor",), ("Adil Wekhulpor",), ("A. Wekhulpor",)], "val string")
    assert {tuple(r) for r in N.variant_pairs(df).collect()} == {("A. Wekhulpor", "Anna Wekhulpor"), ("A. Wekhulpor", "Adil Wekhulpor")}
    assert N.variant_pairs(df.where("val = ''")).count() == 0


@pytest.mark.parametrize(
    "name,want",
    [
        ("Bo, A. K.", (N.INIT, "bo", "a", "k")), ("Aa Bo", (N.FULL, "aa bo", "", "")), ("Bo", (N.ODD, "bo", "", "")), ("Dept. for Xx, Yy Univ.", (N.FULL, "dept. xx yy", "", "")), ("P. van Dijk", (N.INIT, "dijk van", "p", "")),
        ("And Bo", (N.FULL, "and bo", "", "")), ("Aa P. Bo", (N.FULL, "aa bo", "", "p")), ("A.", (N.ODD, "a", "", "")), ("...", (N.ODD, "", "", "")),
    ],
)
def test_parse(name, want):
    kind, tokens, initial, _, _, middle = N.parse(name)
    assert (kind, tokens, initial, middle) == want


def test_pieces():
    assert N.writes_out("technol", "technology") and N.writes_out("mgmt", "management") and not N.writes_out("x", "abc")
    assert N.similarity(["ab"], ["cd"], {}, 1.0) == 0 and N.similarity(["anna", "bergen"], ["anan", "bergen"], {"bergen": 1.0}, 3.0) < N.similarity(["anna", "bergen"], ["anan", "bergen"], {"anna": 1.0}, 3.0)


def pairs(spark, *names):
    return {tuple(r) for r in N.variant_pairs(spark.createDataFrame([(n,) for n in names], "val string")).collect()}


def test_short_words_with_slips(spark):
    assert pairs(spark, "Minh Tran", "Mihn Tran") == {("Mihn Tran", "Minh Tran")}
    assert pairs(spark, "Tanaka, K.", "Tanaak, K.", "Wattana, K.", "Watana, K.") == {("Tanaak, K.", "Tanaka, K."), ("Watana, K.", "Wattana, K.")}
    assert pairs(spark, "Jo Li", "Jo Lu") == set()


def test_middle_names(spark):
    assert pairs(spark, "John A. Smith", "John B. Smith", "John Smith") == {("John A. Smith", "John Smith"), ("John B. Smith", "John Smith")}
    assert pairs(spark, "Smith, J. A.", "Smith, J. B.") == set()
    assert pairs(spark, "Anna Maria Lopez", "Anna Lopez", "Maria Berg") == {("Anna Lopez", "Anna Maria Lopez")}
    assert pairs(spark, "P. van Dijk", "Peter van Dijk", "Kees van Dijk") == {("P. van Dijk", "Peter van Dijk")}


def test_organisations_of_any_language(spark):
    assert pairs(spark, "Toyota Motor Corporation", "Toyota Motor Corp.", "Toyota Motro Corporation") == {("Toyota Motor Corp.", "Toyota Motor Corporation"), ("Toyota Motor Corp.", "Toyota Motro Corporation"), ("Toyota Motor Corporation", "Toyota Motro Corporation")}
    assert pairs(spark, "Universität Hamburg", "UNIVERSITÄT HAMBURG", "Universität Homburg Saar") == {("UNIVERSITÄT HAMBURG", "Universität Hamburg")}


def test_every_pair_that_verifies_meets(spark):
    """The join against a comparison of all pairs of forms, with slips in every word."""
    rng = random.Random(5)
    syllables = ["ka", "mi", "to", "ren", "shu", "bol", "zan", "nir", "wek", "ul"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(2, 4)))

    def slip(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "q" + w[i:], w[:i] + w[i] + w[i:]])

    some = []
    for _ in range(60):
        g, f = word(), word()
        some += [f"{g} {f}", f"{slip(g)} {slip(f)}", f"{f}, {g[0]}.", f"{slip(f)} {g[0]}", f"{g[:4]} {f}", f"{g} {word()} {f}", f"{g} {word()} {f} {word()[:3]}."]
    _, forms = N.forms_of(spark.createDataFrame([(n,) for n in some], "val string"))
    got = {(r.a, r.b, r.how) for r in N.links_of(forms).collect()}
    weight, heavy = N._weights(forms)
    known = [(r.form_id, N._form(*list(r)[1:])) for r in forms.select("form_id", "kind", "tokens", "initial", "given", "inner").collect()]
    want = set()
    for (i, x), (j, y) in combinations(known, 2):
        how = N.relation(x, y, weight, heavy)
        if how:
            want.add((j, i, 2) if how == 3 else (i, j, 2) if how == 2 else (min(i, j), max(i, j), 1))
    assert len(want) > 100 and got == want


def test_answers_do_not_follow_the_size_of_the_table(spark):
    names = ["Anna Wekhulpor", "Anan Wekhulpor", "A. Wekhulpor", "Dept. of Labour Stud., Kyo Univ.", "Department of Labour Studies, Kyo University"]
    alone = pairs(spark, *names)
    others = [f"Given{a}{b}x Family{b}{a}y" for a in "abcdefghij" for b in "klmnopqrst"]
    assert alone and {p for p in pairs(spark, *names, *others) if set(p) <= set(names)} == alone


def test_long_and_hot(spark):
    long = " ".join(["word" + chr(97 + k % 26) for k in range(300)])
    hot = [f"{g} Nguyen" for g in ("Anh", "Binh", "Chi", "Dung", "Giang", "Hoa")]
    assert pairs(spark, long, long.upper(), *hot) == {(long.upper(), long)}
