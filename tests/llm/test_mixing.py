import math
import os

import pytest

from paperloom.llm import mixing as M

needs_tokenizer = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer")


def test_plan_meets_targets_when_it_can():
    p = M.temperature_plan({"a": 100_000, "b": 100_000}, {"a": 0.7, "b": 0.3}, {"a": 2, "b": 2})
    assert p.exponent == 0 and p.sources["a"][2] == 140_000 and p.sources["b"][2] == 60_000


def test_plan_bisects_to_the_limit():
    p = M.temperature_plan({"a": 900, "b": 100, "none": 0}, {"a": 0.3, "b": 0.6, "none": 0.1}, {"a": 1, "b": 3, "none": 4})
    assert 0 < p.exponent < 1 and abs(p.sources["b"][2] - 300) <= 1 and p.sources["a"][2] <= 900 and p.sources["none"][2] == 0
    assert math.isclose(sum(w for _, w, _ in p.sources.values()), 1)


def test_plan_fills_up():
    p = M.temperature_plan({"a": 100, "b": 100}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 5}, total=500)
    assert p.sources["a"][2] == 100 and p.sources["b"][2] == 400
    assert M.temperature_plan({}, {"a": 1.0}, {}).total == 0


def test_shares_of_an_entropy():
    tokens = {"a": 900, "b": 90, "c": 10, "none": 0}
    spread = lambda w: -sum(x * math.log(x) for x in w.values() if x > 0)
    for h in (0.01, 0.3, 0.8, 1.09):
        w = M.temperature_shares(tokens, h)
        assert math.isclose(spread(w), h, abs_tol=1e-6) and w["a"] > w["b"] > w["c"]
    assert all(math.isclose(x, 1 / 3) for x in M.temperature_shares(tokens, 5.0).values())
    assert M.temperature_shares(tokens, 0.0)["a"] > 0.999 and M.temperature_shares({}, 1.0) == {}


@needs_tokenizer
def test_mix(spark):
    docs = [(i, f"text number {i} of many words " * (1 + i % 5), "a" if i % 10 else "b", "x") for i in range(400)] + [(900, None, "a", ""), (901, "no source", None, ""), (902, "odd source", "zzz", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, repeats string").repartition(5)
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(d, t)
    chosen, report = chosen.collect(), {r.source: r for r in report.collect()}
    enc = M.encoder(M.TOKENIZER)
    size = {x[0]: len(enc.encode_ordinary(x[1])) if x[1] else 0 for x in docs}
    assert len({r.doc_id for r in chosen}) == len(chosen)
    for s in ("a", "b"):
        mine = [r for r in chosen if r.source == s]
        assert report[s].tokens_taken == sum(size[r.doc_id] * r.repeats for r in mine)
        assert max(r.repeats for r in mine) <= report[s].max_repeats
        assert report[s].tokens_wanted <= report[s].tokens_taken + 1 and report[s].tokens_taken - report[s].tokens_wanted <= max(size.values())
    assert report["none"].tokens_taken == 0 and math.isclose(sum(r.actual_share for r in report.values()), 1, abs_tol=1e-5)
    assert sorted(map(tuple, M.mix(d.repartition(2), t)[0].collect())) == sorted(map(tuple, chosen))
    assert M.mix(d.where("doc_id < 0"), t)[0].count() == 0
