"""Suppression and average precision of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import iou
from .duplicates import checkpoint_folder

#: The overlaps at which average precision is taken.
OVERLAPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def suppress(rows: DataFrame, image: str = "image", least: float = 0.35, overlap: float = 0.6) -> DataFrame:
    """Rows (image, ord, x1, y1, x2, y2, score) that stay: by falling score, each is dropped if one that stays overlaps it by more, whatever their class.

    One ordered fold over each image's boxes, inside the JVM.
    """
    fields = ("x1", "y1", "x2", "y2")
    box = F.struct((-F.col("score")).alias("o"), F.col("ord"), *fields, "score")
    per = rows.where(F.col("score") >= least).groupBy(image).agg(F.array_sort(F.collect_list(box)).alias("_b"))

    def clashes(a: Column, b: Column) -> Column:
        w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
        h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        cut = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
        size = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return cut > overlap * (size(a) + size(b) - cut)

    stay = F.aggregate("_b", F.slice("_b", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: clashes(k, b)), kept).otherwise(F.concat(kept, F.array(b))))
    return per.select(image, F.explode(stay).alias("k")).select(image, "k.ord", *[f"k.{f}" for f in fields], "k.score")


def matches(predictions: DataFrame, truths: DataFrame, overlap: float = 0.5) -> DataFrame:
    """predictions (image, class_id, pred, score, b) with hit: by falling score, a prediction takes its best truth at the overlap or more.

    A truth is taken by the first prediction that has it for its best: the greedy rule with each prediction's choice
    fixed beforehand, which a join and two ranks express.
    """
    met = predictions.join(truths, ["image", "class_id"]).withColumn("_iou", iou("b", "t")).where(F.col("_iou") >= overlap)
    best = met.groupBy("image", "class_id", "pred").agg(F.max_by("truth", F.struct("_iou", -F.col("truth"))).alias("truth"), F.first("score").alias("score"))
    w = Window.partitionBy("image", "class_id", "truth").orderBy(F.desc("score"), "pred")
    taken = best.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("image", "class_id", "pred", F.lit(1).alias("hit"))
    return predictions.join(taken, ["image", "class_id", "pred"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def matches_at(predictions: DataFrame, truths: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """matches() at each of several overlaps: a row for each prediction, with hits, an array with a 0 or 1 for each overlap, from one join of boxes.

    A prediction's best truth is the same at every overlap that it reaches. It is taken at those that no prediction before has reached with that truth.
    """
    met = predictions.join(truths, ["image", "class_id"]).withColumn("_iou", iou("b", "t")).where(F.col("_iou") >= min(overlaps))
    best = met.groupBy("image", "class_id", "pred").agg(F.max(F.struct("_iou", (-F.col("truth")).alias("_t"))).alias("_m"), F.first("score").alias("score"))
    best = best.select("image", "class_id", "pred", "score", F.col("_m._iou").alias("_iou"), F.col("_m._t").alias("_t"))
    w = Window.partitionBy("image", "class_id", "_t").orderBy(F.desc("score"), "pred").rowsBetween(Window.unboundedPreceding, -1)
    reached = best.withColumn("_before", F.coalesce(F.max("_iou").over(w), F.lit(-1.0))).where("_iou > _before").select("image", "class_id", "pred", "_iou", "_before")
    hits = F.array(*[F.coalesce((F.col("_iou") >= o) & (F.col("_before") < o), F.lit(False)).cast("int") for o in overlaps])
    return predictions.join(reached, ["image", "class_id", "pred"], "left").select("image", "class_id", "pred", "score", hits.alias("hits"))


def _ranked(found: DataFrame, hits: int) -> DataFrame:
    """(class_id, _k, _all, _h, _tp): of each prediction its place by falling score in its class, the number of these, its hits, and the hits up to it, arrays of so many.

    Predictions are dealt by ranges of class and score; counts of each range, of which there are as many as partitions, place it.
    """
    checkpoint_folder(found.sparkSession)
    order = (F.desc("score"), "image", "pred")
    dealt = found.repartitionByRange("class_id", *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = [F.sum(F.get("hits", F.lit(k))).alias(f"_h{k}") for k in range(hits)]
    parts = dealt.groupBy("class_id", "_part").agg(F.count("*").alias("_n"), *counts)
    up = Window.partitionBy("class_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0))
    offsets = parts.select("class_id", "_part", F.sum("_n").over(Window.partitionBy("class_id")).alias("_all"), before("_n").alias("_k0"), F.array(*[before(f"_h{k}") for k in range(hits)]).alias("_tp0"))
    w = Window.partitionBy("class_id", "_part").orderBy(*order)
    own = dealt.select("class_id", "_part", "hits", F.row_number().over(w).alias("_own"), F.array(*[F.sum(F.get("hits", F.lit(k))).over(w) for k in range(hits)]).alias("_up"))
    return own.join(F.broadcast(offsets), ["class_id", "_part"]).select("class_id", (F.col("_k0") + F.col("_own")).alias("_k"), "_all", F.col("hits").alias("_h"), F.zip_with("_tp0", "_up", lambda x, y: x + y).alias("_tp"))


def _precisions(found: DataFrame, truths: DataFrame, points: int, hits: int) -> DataFrame:
    """(at, class_id, ap, precision, recall) for each of so many places of the array hits."""
    n = truths.groupBy("class_id").agg(F.count("*").alias("_n"))
    ranked = _ranked(found, hits).join(F.broadcast(n), "class_id")
    each = F.array(*[F.struct(F.lit(k).alias("at"), F.get("_h", F.lit(k)).alias("h"), F.get("_tp", F.lit(k)).alias("tp")) for k in range(hits)])
    # hits, and the last place, at which all predictions and hits are counted
    each = F.filter(each, lambda x: (x["h"] > 0) | (F.col("_k") == F.col("_all")))
    c = ranked.select("class_id", "_k", "_n", F.explode(each).alias("x")).select(F.col("x.at").alias("at"), "class_id", "_k", "_n", F.col("x.h").alias("h"), F.col("x.tp").alias("tp"))
    # a row for each recall asked for: the best precision of the places at which it is the last one reached; between hits precision only falls
    reached = F.floor(F.col("tp") * (points - 1) / F.col("_n")).cast("int")
    per = c.groupBy("at", "class_id", F.when(F.col("h") > 0, reached).otherwise(-1).alias("x")).agg(F.max(F.when(F.col("h") > 0, F.col("tp") / F.col("_k"))).alias("p"), F.max("_k").alias("k"), F.max("tp").alias("tp"), F.max("_n").alias("n"))
    out = per.groupBy("at", "class_id").agg(F.collect_list(F.struct("x", "p")).alias("_s"), (F.max("tp") / F.max("k")).alias("precision"), (F.max("tp") / F.max("n")).alias("recall"))
    best = lambda x: F.coalesce(F.array_max(F.transform(F.filter("_s", lambda s: s["x"] >= x), lambda s: s["p"])), F.lit(0.0))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), best), F.lit(0.0), lambda a, v: a + v)
    return out.select("at", "class_id", (total / points).alias("ap"), "precision", "recall")


def average_precision(found: DataFrame, truths: DataFrame, points: int = 101) -> DataFrame:
    """(class_id, ap, precision, recall): interpolated precision at evenly spaced recalls, and both at the end of the list."""
    return _precisions(found.select("image", "class_id", "pred", "score", F.array("hit").alias("hits")), truths, points, 1).drop("at")


def mean_average_precision(predictions: DataFrame, truths: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """(class_id, ap50, ap50_95): average precision at the least overlap and its mean over all; the row without a class is the mean of the classes."""
    ap = _precisions(matches_at(predictions, truths, overlaps), truths, 101, len(overlaps))
    per = ap.groupBy("class_id").agg(F.max(F.when(F.col("at") == overlaps.index(min(overlaps)), F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return per.unionByName(per.agg(F.lit(None).cast("int").alias("class_id"), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95")))
