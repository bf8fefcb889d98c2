"""Mixing sources to target weights, in tokens of a public tokenizer.

Weights are propagated through a tree of domains, their languages and their sources: a source's target weight is spread over its leaves by their
tokens, and a node weighs what its leaves weigh. Budgets run down by these weights; what a leaf can't give, even with
its texts repeated as often as allowed, goes to its siblings first and then to those of its ancestors. Each leaf's budget is filled in
whole epochs and the prefix of a last one; every epoch has its own seeded order.

The prefix is found without any leaf in one task: tokens are summed by slices of the order, the slice with the border is
found from the sums, and only that slice is ordered itself.

Defined cases: NULL and empty texts have no tokens and are left out; sources are compared without case, signs and blanks
(a NULL source is in no mix); domains and languages without a value are one of their own; repeated ids count as documents of their own;
an empty table or no target gives an empty mix; the text on the border of a budget is in if at least half of it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.common import checkpointed

#: The tokenizer's file where neither the argument nor the setting ``spark.skyloom.tokenizer`` names another; only the driver needs it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that the byte-level vocabulary is split by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slices of a leaf's order; the one with the border is all that is sorted.
SLICES = 4096


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, name: str = "tokens", tokenizer: str | None = None) -> DataFrame:
    """The table with the number of tokens of a text column; 0 for NULL and empty texts. The driver ships the tokenizer to the executors."""
    spark = df.sparkSession
    path = tokenizer or spark.conf.get("spark.skyloom.tokenizer", TOKENIZER)
    spark.sparkContext.addFile(path)
    file = os.path.basename(path)

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(SparkFiles.get(file))
        for s in parts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn(name, count(text))


def source_key(c: Column) -> Column:
    """A source's name without case, signs and blanks."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def budgets(leaves: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], total: float) -> dict[tuple[str, ...], float]:
    """Tokens for each leaf (a path). ``leaves``: what each can give; ``weights``: of paths, an unnamed child counts by what it can give."""

    def children(path: tuple[str, ...], n: int) -> list[tuple[str, ...]]:
        return sorted({p[: n + 1] for p in leaves if p[:n] == path and len(p) > n})

    def cap(path: tuple[str, ...]) -> float:
        return sum(v for p, v in leaves.items() if p[: len(path)] == path)

    out: dict[tuple[str, ...], float] = {}

    def spread(path: tuple[str, ...], amount: float) -> None:
        if path in leaves:
            out[path] = min(amount, leaves[path])
            return
        kids = children(path, len(path))
        caps = {k: cap(k) for k in kids}
        w = {k: weights.get(k, caps[k] if not any(x in weights for x in kids) else 0.0) for k in kids}
        got = dict.fromkeys(kids, 0.0)
        left, open_ = min(amount, sum(caps.values())), {k for k in kids if w[k] > 0 and caps[k] > 0}
        while left > 1e-9 and open_:  # what a full child can't take goes to its siblings
            s = sum(w[k] for k in open_)
            full = {k for k in open_ if got[k] + left * w[k] / s >= caps[k]}
            if not full:
                for k in open_:
                    got[k] += left * w[k] / s
                left = 0.0
                break
            for k in full:
                left -= caps[k] - got[k]
                got[k] = caps[k]
            open_ -= full
        for k in kids:
            spread(k, got[k])

    if leaves:
        spread((), total)
    return out


def propagated(leaves: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """The weights of all nodes of a tree, from those of its leaves."""
    out: dict[tuple[str, ...], float] = {}
    for path, w in leaves.items():
        for n in range(1, len(path) + 1):
            out[path[:n]] = out.get(path[:n], 0.0) + w
    return out


#: The levels of the tree from the root down.
LEVELS = ("domain", "lang", "source")


def product_line() -> Column:
    """The domain of a review: the letters and first two digits of its item's number."""
    return F.regexp_extract(F.upper("item_sku"), r"^([A-Z]+-?[0-9]{0,2})", 1)


def mixed(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", total: float | None = None, stretch: float = 1.0, seed: int = 17,
    tokenizer: str | None = None, domain: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, domain, lang, source, tokens, copies) and its report (source, target_share, tokens, share, copies).

    Without ``total`` the mix is ``stretch`` times the largest in which every target that has texts at all gets its share exactly;
    a larger one has shortages.
    """
    want = {}
    for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(
        source_key(F.col("source")).alias("s"), "source", "target_share", "max_repeats"
    ).collect():
        want[r["s"]] = (r["source"], r["target_share"], max(1, r["max_repeats"] or 1))  # one row a target
    if domain is None:
        domain = product_line() if "item_sku" in docs.columns else F.lit(None).cast("string")
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    spark = docs.sparkSession
    base = docs.select(
        F.col(key).alias("doc_id"), named(domain).alias("domain"), named(F.lower(F.trim("lang"))).alias("lang"),
        source_key(F.col("source")).alias("source"), F.col(text).alias("_t")
    )
    names = spark.createDataFrame([(s, *v) for s, v in want.items()], "source string, name string, target_share double, max_repeats long")
    base = base.join(F.broadcast(names.select("source", "name", "max_repeats")), "source")
    base = checkpointed(token_counts(base, "_t", "tokens", tokenizer).drop("_t").where("tokens > 0").withColumn("leaf", F.concat_ws("\u0001", *LEVELS)))
    sums = base.groupBy("leaf", *LEVELS).agg(F.sum("tokens").alias("n")).collect()  # one row a leaf
    have: dict[str, int] = {}
    for r in sums:
        have[r["source"]] = have.get(r["source"], 0) + r["n"]
    if total is None:
        total = stretch * min((have[s] * want[s][2] / (want[s][1] / sum(want[q][1] for q in have)) for s in have), default=0.0)
    leaves = {tuple(r[c] for c in LEVELS): float(r["n"] * want[r["source"]][2]) for r in sums}
    weights = propagated({tuple(r[c] for c in LEVELS): want[r["source"]][1] * r["n"] / have[r["source"]] for r in sums})
    budget = budgets(leaves, weights, total)
    rows = [(r["leaf"], int(budget[tuple(r[c] for c in LEVELS)] // r["n"]), float(budget[tuple(r[c] for c in LEVELS)] % r["n"])) for r in sums]
    plan = spark.createDataFrame(rows, "leaf string, epochs long, rest double")
    planned = base.join(F.broadcast(plan), "leaf")
    place = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    planned = planned.withColumns({"_o": place, "_slice": F.shiftrightunsigned(place, 64 - 12)})
    slices = planned.groupBy("leaf", "_slice").agg(F.sum("tokens").alias("_n"))  # at most SLICES a leaf
    before = slices.withColumn("_before", F.sum("_n").over(Window.partitionBy("leaf").orderBy("_slice")) - F.col("_n"))
    planned = planned.join(before, ["leaf", "_slice"])
    inside = planned.where((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_n") > F.col("rest")))
    upto = F.col("_before") + F.sum("tokens").over(Window.partitionBy("leaf", "_slice").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("copies", F.col("epochs") + F.when(upto - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    outside = planned.where((F.col("_before") >= F.col("rest")) | (F.col("_before") + F.col("_n") <= F.col("rest"))).withColumn(
        "copies", F.col("epochs") + F.when(F.col("_before") + F.col("_n") <= F.col("rest"), 1).otherwise(0)
    )
    cols = ["doc_id", "domain", "lang", F.col("name").alias("source"), "tokens", "copies"]
    mix = inside.select(*cols).unionByName(outside.select(*cols)).where("copies > 0")
    taken = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies"))
    all_ = taken.agg(F.sum("tokens").alias("_all"))
    report = names.select(F.col("name").alias("source"), "target_share").join(taken, "source", "left").join(F.broadcast(all_)).select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("share"), F.coalesce("copies", F.lit(0)).alias("copies")
    )
    return mix, report
