"""Problem 7: mixing sources to target weights, by temperature.

With p the sources' shares of the tokens there are and q their target shares,
the weights are ``q * (p / q) ** a``, normalised.  The exponent ``a`` is 0 for
the targets themselves and 1 for the natural shares; bisection finds the
smallest one for which no source is repeated more often than it may be at the
wanted size.  Without targets of one's own, ``entropy`` gives some: the shares
``p ** t``, normalised, with ``t`` bisected to that entropy.  A source's budget is realised as whole passes over it plus a
part of one more pass, taken in the order of a keyed permutation of blocks;
only the block in which the budget ends is ordered by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.session import materialise, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents a block holds on average, and the most blocks a source is cut into.
BLOCK_DOCS, MOST_BLOCKS = 64, 4096
#: Blocks of all sources together up to which their sums are sent to every task; more are joined by a shuffle.
MOST_SENT = 200_000
# Fixed value: the public pattern that splits text before byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, made once per worker."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, no: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(no, source, tokens)`` for every row; a null text has 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"no": b["no"], "source": b["source"], "tokens": [len(encode(t)) if t else 0 for t in b["t"]]})

    return documents.select(F.col(no).cast("bigint").alias("no"), F.col(source).alias("source"), F.col(text).alias("t")).mapInPandas(run, "no bigint, source string, tokens bigint")


@dataclass
class Plan:
    """The exponent, the size aimed at, and of each source (target, weight, budget)."""

    exponent: float
    total: int
    sources: dict[str, tuple[float, float, int]]


def temperature_shares(tokens: dict[str, int], entropy: float) -> dict[str, float]:
    """The sources' token shares raised to a power and normalised, the power bisected to the entropy (in nats) wanted; even shares where that is more than they have, one source's where it is 0."""
    have = {s: n for s, n in tokens.items() if n > 0}
    n = sum(have.values())

    def shares(t: float) -> dict[str, float]:
        top = max(have.values())
        w = {s: (x / top) ** t for s, x in have.items()}
        z = math.fsum(w.values())
        return {s: x / z for s, x in w.items()}

    def spread(t: float) -> float:
        return -math.fsum(x * math.log(x) for x in shares(t).values() if x > 0)

    if not n:
        return {}
    low, high = 0.0, 1.0
    if spread(low) <= entropy:
        return shares(low)
    while spread(high) > entropy and high < 1 << 40:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if spread(mid) <= entropy else (mid, high)
    return shares(high)


def temperature_plan(tokens: dict[str, int], target: dict[str, float], most: dict[str, int], total: int | None = None) -> Plan:
    """Weights and budgets in tokens.

    ``total`` is the size of the mixture, by default the tokens there are; it
    is lowered to what all repeats allow together.  Sources without tokens or
    without a positive target have budget 0, their target is spread over the
    others in proportion.
    """
    have = {s: n for s, n in tokens.items() if n > 0 and target.get(s, 0) > 0}
    if not have:
        return Plan(0.0, 0, {s: (q, 0.0, 0) for s, q in target.items()})
    n = sum(have.values())
    q = {s: target[s] / sum(target[x] for x in have) for s in have}
    room = {s: have[s] * max(1, most.get(s) or 1) for s in have}
    total = min(n if total is None else total, sum(room.values()))

    def weights(a: float) -> dict[str, float]:
        w = {s: q[s] * (have[s] / n / q[s]) ** a for s in have}
        z = math.fsum(w.values())
        return {s: x / z for s, x in w.items()}

    def fits(a: float) -> bool:
        return all(x * total <= room[s] * (1 + 1e-12) for s, x in weights(a).items())

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    elif not fits(1.0):  # more than one pass over everything is wanted: fill what is full, share the rest
        return Plan(1.0, total, _filled(q, room, total, target))
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    w = weights(high)
    return Plan(high, total, {s: (target[s], w.get(s, 0.0), min(room[s], round(w[s] * total)) if s in w else 0) for s in target})


def _filled(q: dict[str, float], room: dict[str, int], total: int, target: dict[str, float]) -> dict[str, tuple[float, float, int]]:
    budget: dict[str, float] = {}
    open_, left = dict(q), float(total)
    while open_:
        z = sum(open_.values())
        full = [s for s, x in open_.items() if x / z * left >= room[s]]
        if not full:
            budget |= {s: x / z * left for s, x in open_.items()}
            break
        for s in full:
            budget[s] = room[s]
            left -= room[s]
            del open_[s]
    return {s: (target[s], budget.get(s, 0) / total, min(room[s], round(budget[s])) if s in budget else 0) for s in target}


@tidy
def mix(documents: DataFrame, targets: DataFrame, no: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER, entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)``.

    ``chosen``: ``(no, source, repeats)`` of every document that is taken,
    with how often.  ``report``: for each source of ``targets`` its target,
    the most and the taken repeats, the tokens there are, aimed at and taken,
    and its actual share.  A budget ends with the document that reaches it,
    or before it where that document would exceed the most repeats.  Rows
    with a null source, or one without target, are left out; targets are one
    row per source (the first by share where repeated).  With ``entropy`` the
    sources of ``targets`` get :func:`temperature_shares` as targets instead.
    """
    spark = documents.sparkSession
    counts = materialise(token_counts(documents, no, text, source, tokenizer), "tokens")
    per = {r.source: r for r in counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).join(targets.select(F.col("source").alias("_s")).distinct(), F.col("source") == F.col("_s"), "left_semi").collect()}
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("q"), F.max("max_repeats").alias("most")).collect()
    target, most = {r.source: float(r.q or 0) for r in wanted}, {r.source: int(r.most or 1) for r in wanted}
    tokens = {s: int(per[s].tokens or 0) if s in per else 0 for s in target}
    if entropy is not None:
        target = dict.fromkeys(target, 0.0) | temperature_shares(tokens, entropy)
    plan = temperature_plan(tokens, target, most, total)
    rows = []
    for s, (q, w, budget) in plan.sources.items():
        whole = min(budget // tokens[s], most[s]) if tokens[s] else 0
        rest = budget - whole * tokens[s] if whole < most[s] else 0
        blocks = max(1, min(MOST_BLOCKS, per[s].docs // BLOCK_DOCS)) if s in per else 1
        rows.append((s, q, w, most[s], tokens[s], budget, whole, rest, blocks))
    p = F.broadcast(spark.createDataFrame(rows, "source string, target_share double, weight double, max_repeats int, tokens_available bigint, tokens_wanted bigint, whole bigint, rest bigint, blocks int"))
    d = counts.join(p.select("source", "whole", "rest", "blocks"), "source")
    d = d.withColumn("block", F.pmod(F.xxhash64("no", F.lit(seed)), F.col("blocks")))
    sums = d.groupBy("source", "block").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("t").over(order)).select("source", "block", (F.col("upto") - F.col("t")).alias("before"), F.col("upto"), "t")
    d = d.join(F.broadcast(sums) if sum(r[-1] for r in rows) <= MOST_SENT else sums, ["source", "block"])
    inside = d.where("before < rest and upto > rest")
    w = Window.partitionBy("source", "block").orderBy(F.xxhash64("no", F.lit(seed + 2)), "no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("got", F.col("before") + F.sum("tokens").over(w) - F.col("tokens")).where("got < rest").select("source", "no", "tokens", (F.col("whole") + 1).alias("repeats"), "whole")
    others = d.where("not (before < rest and upto > rest)").select("source", "no", "tokens", (F.col("whole") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("repeats"), "whole")
    cut = d.where("before < rest and upto > rest").select("source", "no", "tokens", F.col("whole").alias("repeats"), "whole").join(inside.select("no"), "no", "left_anti")
    cols = ["source", "no", "tokens", "repeats"]
    taken = materialise(inside.select(cols).unionByName(others.select(cols)).unionByName(cut.select(cols)).where("repeats > 0"), "taken")
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_taken"), F.max("repeats").cast("int").alias("repeats"), F.count("*").alias("docs_taken"))
    report = p.select("source", "target_share", "max_repeats", "tokens_available", "tokens_wanted").join(got, "source", "left")
    report = report.select("source", "target_share", "max_repeats", F.coalesce("repeats", F.lit(0)).alias("repeats"), "tokens_available", "tokens_wanted", F.coalesce("tokens_taken", F.lit(0)).alias("tokens_taken"), F.coalesce("docs_taken", F.lit(0)).alias("docs_taken"))
    whole = F.sum("tokens_taken").over(Window.partitionBy(F.lit(1)))  # one row per source of the targets
    report = report.withColumn("actual_share", F.when(whole > 0, F.round(F.col("tokens_taken") / whole, 6)).otherwise(F.lit(0.0)))
    return taken.select(F.col("no").alias(no), "source", "repeats"), report
