import random
from itertools import combinations

import pytest

from paperloom.llm import spans as S


def texts(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh é語") for _ in range(rnd.randrange(3, 9)))
    passages = [" ".join(word() for _ in range(80))[: rnd.choice([140, 299, 300, 301, 380])] for _ in range(8)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 90)))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), " ".join(word() for _ in range(rnd.randrange(1, 60)))]
        out.append("".join(parts))
        if rnd.random() < 0.15:
            out[-1] = rnd.choice(out)
    return out


def brute(ts, span):
    where = {}
    for i, t in enumerate(ts):
        for k in range(len(t) - span + 1):
            where.setdefault(t[k : k + span], {}).setdefault(i, []).append(k)
    pairs = {p for v in where.values() for p in combinations(sorted(v), 2)}
    covered = [set() for _ in ts]
    for v in where.values():
        if len(v) > 1:
            for i, ks in v.items():
                for k in ks:
                    covered[i].update(range(k, k + span))
    return pairs, [len(c) for c in covered]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_and_coverage(spark, seed):
    ts = texts(seed)
    want, covered = brute(ts, 300)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ts)] + [(900, None, ""), (901, "", "")], "doc_id bigint, text string, a string").repartition(3)
    got = [tuple(r) for r in S.sharing_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    cov = {r.doc_id: (r.n_chars, r.shared_chars) for r in S.coverage(df).collect()}
    assert cov.pop(900) == (0, 0) and cov.pop(901) == (0, 0)
    assert cov == {i: (len(t), covered[i]) for i, t in enumerate(ts)}


def test_passes_and_shuffle_agree(spark, monkeypatch):
    ts = texts(9)
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id bigint, text string")
    want = brute(ts, 300)[0]
    monkeypatch.setattr(S, "FILTER_BLOCKS", 40)
    assert {tuple(r) for r in S.sharing_pairs(df).collect()} == want
    monkeypatch.setattr(S, "MOST_PASSES", 1)
    assert {tuple(r) for r in S.sharing_pairs(df).collect()} == want


def test_copies_and_empty(spark):
    df = spark.createDataFrame([(i, "long text " * 40) for i in range(4)] + [(9, "short")], "doc_id bigint, text string")
    assert S.sharing_pairs(df).count() == 6 and S.shared_spans(df)[1].count() == 0
    assert S.sharing_pairs(df.where("doc_id < 0")).count() == 0
    assert {r.doc_id: r.shared_chars for r in S.coverage(df).collect()} == {0: 400, 1: 400, 2: 400, 3: 400, 9: 0}


def test_very_long_text():
    t = "".join(chr(97 + (i * i) % 23) for i in range(400_000))
    h = S.prefix_hashes(t)
    w = S.window_hashes(h, slice(None), 150)
    assert len(w) == len(t) - 149 and w[7] == S.window_hashes(S.prefix_hashes(t[7:157]), slice(None), 150)[0]
    assert S.maximal_repeats("xx" + t[:1000], "y" + t[:900], [(52, 51)], 300) == [(2, 1, 900)]
