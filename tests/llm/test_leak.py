import random

import pytest

from paperloom.llm import leak as L

WORDS = [f"{a}{b}" for a in ("lan", "mor", "tis", "vek", "dol", "han") for b in ("ta", "re", "mi", "on", "ed", "ing", "or", "al")]
OPENER = "read the case and decide whether"


def make(seed):
    rnd = random.Random(seed)
    items = [(i, (OPENER + " " if i % 2 else "") + " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(18, 30)))) for i in range(40)]
    docs, want = [], set()
    for d in range(120):
        w = [rnd.choice(WORDS) for _ in range(rnd.choice([0, 60, 300]))]
        i, t = rnd.choice(items)
        iw = L.passage_words(t)
        kind = rnd.choice(["none", "whole", "half", "replaced", "scrap", "opener", "broken"])
        p = list(iw)
        if kind == "half":
            p = iw[-(len(iw) * 3 // 5) :]
        elif kind == "replaced":
            p[len(p) // 3] = "other"
            p[len(p) * 2 // 3] = "else"
        elif kind == "scrap":
            p = iw[: len(iw) // 4]
        elif kind == "opener":
            p = OPENER.split()
        text = " ".join(p)
        if kind == "broken":
            text = text.upper().replace(" ", ",\n", 1)
            text = text[: len(text) - 3] + "-\n" + text[-3:]
        if kind == "none":
            text = ""
        k = rnd.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:k]) + " " + text + " " + " ".join(w[k:]), "x"))
        if kind in ("whole", "half", "replaced", "broken"):
            want.add((d, i))
    return docs, items, want


@pytest.mark.parametrize("seed", range(2))
def test_leaks(spark, seed):
    docs, items, want = make(seed)
    d = spark.createDataFrame(docs + [(900, None, ""), (901, "", "")], "doc_id bigint, text string, item_id string").repartition(3)
    i = spark.createDataFrame(items + [(900, None), (901, "two words")], "item_id bigint, text string")
    got = [tuple(r) for r in L.leaked(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.item_id: r.n_docs for r in L.report(d, i).collect()}[901] == 0
    assert L.leaked(d.where("doc_id < 0"), i).count() == 0 and L.leaked(d, i.where("item_id < 0")).count() == 0


def test_chunks_give_the_same(spark, monkeypatch):
    docs, items, want = make(7)
    monkeypatch.setattr(L, "CHUNK_TRIPLES", 150)
    d, i = spark.createDataFrame([x[:2] for x in docs], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in L.leaked(d, i).collect()} == want


def test_stray_line_and_long_text():
    ix = L.ItemIndex([(1, [f"w{k}" for k in range(24)])])
    w = [f"w{k}" for k in range(24)]
    assert ix.found_in(["q"] * 50_000 + w[2:9] + ["12"] + w[9:16] + ["q"]) == [1]
    assert ix.found_in(w[:6]) == [] and ix.found_in([]) == []
    assert L.sketch_size(34) == 32 and L.sketch_size(5000) < 200


@pytest.mark.parametrize("chunk", [4_000_000, 30])
def test_shared_wording(spark, monkeypatch, chunk):
    """Copies of an item and a common passage leak like other words; an opening and a scrap do not, in whatever chunks."""
    monkeypatch.setattr(L, "CHUNK_TRIPLES", chunk)
    w = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    opener = w("open", 9)
    items = [(k, w("copy", 20)) for k in range(4)]  # one text
    items += [(10 + k, f"{w('pass', 14)} {w(f'ask{k}', 6)}") for k in range(3)]  # one passage, first
    items += [(20 + k, f"{w(f'say{k}', 4)} {w('mid', 14)} {w(f'end{k}', 2)}") for k in range(3)]  # one passage, inside
    items += [(30 + k, f"{opener} {w(f'own{k}', 11)}") for k in range(4)]
    items += [(40 + k, f"{opener} {w('base', 9)} {w(f'last{k}', 2)}") for k in range(3)]  # an opening, then a passage
    items += [(50 + k, f"{opener} on{k} or to{k} gives way to {w(f'rest{k}', 6)}") for k in range(4)]  # a turn of speech
    docs = [(1, f"q q {w('copy', 20)} q"), (2, f"q {w('pass', 12)} q"), (3, f"q {w('mid', 12)} q"), (4, f"q {opener} own00 own01 q"), (5, f"q {opener} own10 own11 x own13 q"), (6, f"q {opener} base0 q"), (7, f"q {opener} {w('base', 5)} q"), (8, f"q {opener} x or y gives way to q"), (9, f"q {opener} own30 x own32 y own34 q")]
    want = {(1, k) for k in range(4)} | {(2, 10 + k) for k in range(3)} | {(3, 20 + k) for k in range(3)} | {(5, 31), (9, 33)} | {(7, 40 + k) for k in range(3)}
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    assert {tuple(r) for r in L.leaked(d, i).collect()} == want


def test_long_items_through_their_sketches(spark):
    """Items of 200 to 5,000 words keep some forty triples, and half of an item with two words replaced, or cut by a stray line, is found."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(900)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([200, 400, 1000, 5000])))) for i in range(60)]
    assert all(L.sketch_size(n) == n - 2 for n in (3, 12, 30, 34)) and L.sketch_size(60) < 58 and all(30 <= L.sketch_size(n) <= 80 for n in (100, 200, 1000, 5000, 100_000))
    docs, want = [], set()
    for d in range(300):
        i = rnd.randrange(60)
        w = items[i][1].split(" ")
        n = -(-len(w) // 2)
        at = rnd.randrange(len(w) - n + 1)
        p = w[at : at + n]
        p[n // 3] = p[2 * n // 3] = "zzz"
        if d % 3 == 0:
            k = rnd.randrange(5, n - 5)
            p = [*p[:k], "page", "12", "of", "30", *p[k:]]
        if d % 5 == 4:
            p = p[: n // 2]  # too little
        else:
            want.add((d, i))
        around = [rnd.choice(words) for _ in range(40)]
        docs.append((d, " ".join(around[:20] + p + around[20:])))
    got = {tuple(r) for r in L.leaked(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_common_opening_is_no_evidence_however_items_are_cut(spark, monkeypatch):
    opening = "one two three four five six seven eight nine ten eleven twelve"
    items = [(i, f"{opening} {' '.join(f'w{i}x{chr(97 + k)}' for k in range(14))}") for i in range(4)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"so {opening} and more"), (2, items[2][1])], "doc_id bigint, text string")
    for most in (4_000_000, 1):
        monkeypatch.setattr(L, "CHUNK_TRIPLES", most)
        assert {tuple(r) for r in L.leaked(docs, frame).collect()} == {(2, 2)}
