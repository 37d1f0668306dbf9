import pytest

from paperloom.llm import lookalike as L

CASES = [
    ("SURVΕY", "SURVEY", True), ("Ｓｉｔｅ ２", "Site 2", True), ("café", "café", True), ("a​b", "ab", True), ("ﬁne", "fine", True), ("a b", "a b", True), ("a　b", "a b", True),
    ("Rírcalnula", "Rírcalnula", False), ("a – b", "a – b", False), ("N ≥ 4", "N ≥ 4", False), ("Δ-Scores", "Δ-Scores", False), ("Москва", "Москва", False), ("仕事と世代", "仕事と世代", False), ("a\nb\tc", "a\nb\tc", False),
    ("plain", "plain", False), ("", "", False), (None, None, False), ("การทำงาน", "การทำงาน", False), ("Тuyate", "Tuyate", True), ("x² ½", "x² ½", False),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, a, a, "e") for i, (a, _, _) in enumerate(CASES)], "cand_no bigint, title string, authors string, title_changed string")
    got = {r.cand_no: r for r in L.unify(df).collect()}
    for i, (_, want, changed) in enumerate(CASES):
        assert got[i].title == want and got[i].title_changed == changed, CASES[i]
    found = {tuple(r) for r in L.changed_fields(df).collect()}
    assert found == {(i, f) for i, c in enumerate(CASES) if c[2] for f in ("title", "authors")}
    assert L.changed_fields(df.where("cand_no < 0")).count() == 0


def test_all_latin_words_survive():
    assert L.unified("Học hỏi giữa các thế hệ") == "Học hỏi giữa các thế hệ"


@pytest.mark.parametrize("word", ["sсhооl", "Ноtеl", "ехреriеnсе"])
def test_several_letters(word):
    assert L.read_word(word).isascii()


def test_long_text():
    assert L.unified("аb " * 50_000) == "ab " * 50_000
