"""Balanced assignment of whole scenes to splits, and the verdict on a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of train, val and test, weights of images, both classes and groups, and the excess over a target that costs more.
SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))
WEIGHTS = (1.0, 1.0, 1.0, 0.5)
EXCESS, EXCESS_WEIGHT = 0.03, 6.0


def assign(groups: DataFrame, key: str = "group_id", order: list[str] | None = None) -> DataFrame:
    """(key, split): each whole group to the split for which the weighted squared deviation from the wanted counts, each taken as a share of its target, ends up least.

    groups has images, class0 and class1. Larger groups come first, then by key; ties go to train, val, test in this
    order. Every choice depends on all before it, so one ordered fold runs over one array of groups, not of images:
    its size is the number of scenes.
    """
    cols = ("images", "class0", "class1")
    vec = F.array(*[F.col(c).cast("double") for c in cols], F.lit(1.0))
    one = groups.select(F.struct((-F.col("images")).alias("o"), F.col(key).alias("k"), vec.alias("v")).alias("g")).agg(F.array_sort(F.collect_list("g")).alias("all"))
    totals = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.aggregate("all", F.lit(0.0), lambda a, g: a + F.get(g["v"], i)))
    one = one.withColumn("total", totals)
    zero = F.struct(F.array(*[F.array_repeat(F.lit(0.0), 4) for _ in SHARES]).alias("have"), F.array().cast("array<int>").alias("to"))
    weights = F.array(*map(F.lit, WEIGHTS))

    def cost(have, share: float):
        wanted = F.transform("total", lambda t: t * share)
        off = F.zip_with(have, wanted, lambda h, t: (h - t) / F.greatest(t, F.lit(1.0)))
        over = F.zip_with(have, wanted, lambda h, t: F.greatest(h - t * (1 + EXCESS), F.lit(0.0)) / F.greatest(t, F.lit(1.0)))
        squares = F.concat(F.zip_with(off, weights, lambda r, w: w * r * r), F.transform(over, lambda r: EXCESS_WEIGHT * r * r))
        return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)

    def step(acc, g):
        have = [F.get(acc["have"], F.lit(i)) for i in range(3)]
        plus = [F.zip_with(h, g["v"], lambda a, b: a + b) for h in have]
        now = [cost(h, s) for h, (_, s) in zip(have, SHARES, strict=True)]
        then = [cost(p, s) for p, (_, s) in zip(plus, SHARES, strict=True)]
        change = F.transform(F.array(*[t - n for t, n in zip(then, now, strict=True)]), lambda x: F.round(x, 12))
        to = F.array_position(change, F.array_min(change)).cast("int") - 1
        return F.struct(F.array(*[F.when(to == i, plus[i]).otherwise(have[i]) for i in range(3)]).alias("have"), F.concat(acc["to"], F.array(to)).alias("to"))

    done = one.select("all", F.aggregate("all", zero, step)["to"].alias("to"))
    names = F.array(*[F.lit(n) for n, _ in SHARES])
    return done.select(F.explode(F.arrays_zip("all", "to")).alias("x")).select(F.col("x.all.k").alias(key), F.get(names, F.col("x.to")).alias("split"))


def decision(expected: DataFrame, assigned: DataFrame, groups: DataFrame, leaking_pairs: DataFrame, name: str = "image") -> DataFrame:
    """missing, unexpected, leaking_groups, leaking_pairs, passed."""
    e, a = expected.select(name).distinct(), assigned.select(name).distinct()
    leaks = assigned.join(groups, name).groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1")
    out = e.join(a, name, "left_anti").agg(F.count("*").alias("missing")).join(a.join(e, name, "left_anti").agg(F.count("*").alias("unexpected")), how="cross")
    out = out.join(leaks.agg(F.count("*").alias("leaking_groups")), how="cross").join(leaking_pairs.agg(F.count("*").alias("leaking_pairs")), how="cross")
    return out.withColumn("passed", (F.col("missing") + F.col("unexpected") + F.col("leaking_groups") + F.col("leaking_pairs")) == 0)
