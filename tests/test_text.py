import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "value,want",
    [("Employee Voice and Power Distance in Vietnam", "employee_voice_and_power_distance_in_vietnam"), ("", "untitled"), (None, "untitled"), ("日本", "untitled"), ("Ｆｕｌｌ wídth — ﬁne", "full_width_fine"), ("x" * 70, "x" * 50)],
)
def test_short_title(spark, value, want):
    assert one(spark, T.short_title, value) == want


def py_norm(t):
    t = unicodedata.normalize("NFKD", t or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]+", " ", t)).strip()


def test_normalise_and_slug(spark):
    values = ["Déjà Vu: A-B  c", "", None, "  ", "Học hỏi Ｔｅｓｔ", "a b", "①Ⅳ½", "x\ny"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", T.normalize_title("x").alias("n"), T.slugify("x").alias("s")).orderBy("i").collect()
    assert [r.n for r in got[:6]] == [py_norm(v) for v in values[:6]]
    assert got[0].s == "deja_vu_a_b_c" and got[1].s == "untitled"


def test_fold_equals_exact(spark):
    chars = [chr(o) for o in range(0x80, 0x3100) if len("".join(x for x in unicodedata.normalize("NFKD", chr(o)) if x < "\x80")) <= 1]
    df = spark.createDataFrame([(c,) for c in chars], "x string")
    assert df.where(T.ascii_fold("x") != T.ascii_fold_exact("x")).count() == 0


def test_record_id(spark):
    df = spark.createDataFrame([(" 10.1/AB ", "t"), ("", "A  Title"), (None, None)], "d string, t string")
    a, b, c = [r.i for r in df.select(T.record_id("d", "t").alias("i")).collect()]
    assert a == "doi:10.1/ab"
    assert b == "ttl:" + hashlib.sha1(b"a title").hexdigest()[:16]
    assert c.startswith("raw:") and len(c) == 20


@pytest.mark.parametrize("url,want", [("https://User@WWW.Example.org:8080/x?y", "www.example.org"), ("//a_b.example/p", "a_b.example"), ("http://[::1]/x", "::1"), ("nothing", ""), (None, ""), ("", "")])
def test_host(spark, url, want):
    assert one(spark, T.host, url) == want


def test_text_helpers(spark):
    assert one(spark, T.normalize_text, "exam-\n ple -LRB-x-RRB-\r\ncafé-\nté\xad") == "example (x)\ncafété"
    assert one(spark, T.collapse_spaces, "　a \t b ") == "a b"
    assert one(spark, T.strip_tags, "<jats:p>a</jats:p>") == "a"
    assert one(spark, T.word_count, None) == 0
    assert one(spark, T.word_count, " a　b\nc ") == 3
    assert one(spark, T.whole_number, "12") == 12 and one(spark, T.whole_number, "x") == 0
    assert one(spark, T.token_sort, "b a  c") == "a b c"


def test_present(spark):
    df = spark.createDataFrame([("", 0, False), (None, None, None), ("x", 1, True)], "s string, n int, b boolean")
    got = df.select(T.present("s").alias("s"), T.present("n", "number").alias("n"), T.present("b", "boolean").alias("b")).collect()
    assert [tuple(r) for r in got] == [(False,) * 3, (False,) * 3, (True,) * 3]


def test_fold_is_exact_for_every_sign(spark):
    """All signs of the basic plane that unfold to ASCII, and some beyond it, one by one and together."""
    import unicodedata

    from paperloom.functions import text as T

    signs = [chr(o) for o in [*range(0x80, 0xD800), *range(0xE000, 0x10000), 0x1D400, 0x1F100, 0x1F600] if unicodedata.normalize("NFKD", chr(o)) != chr(o) or o > 0xFFFF]
    rows = [f"a{s}b" for s in signs] + ["é½ﬁⅧ㎏x", "", None]
    got = [r.x for r in spark.createDataFrame([(r,) for r in rows], "s string").select(T.ascii_fold("s").alias("x")).collect()]
    assert got == ["" if r is None else unicodedata.normalize("NFKD", r).encode("ascii", "ignore").decode() for r in rows]
