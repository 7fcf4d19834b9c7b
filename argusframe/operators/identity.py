"""Who is there: gallery search, votes, faces in person boxes, and identity metrics of an assignment sequence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dense

#: Rows of a block of probes or of the gallery, blocks into which fewer probes are cut for the sake of all cores, and products held at once.
BLOCK, LEAST_BLOCKS, SMALL_BLOCK, SLAB = 1 << 13, 12, 1 << 9, 1 << 20


def _best(p: np.ndarray, g: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of p the row of g with the largest inner product, the least in order on ties, and that product; -1 and -inf for none that is a number.

    Candidates come from a matrix product; those that its rounding leaves open are summed again one component after the
    other, as functions.vectors.dot does, so equal samples tie.
    """
    best, score = np.full(len(p), -1), np.full(len(p), -np.inf)
    if not len(g):
        return best, score
    exact = np.isfinite(p).all() and np.isfinite(g).all()
    slack = 8 * (p.shape[1] + 1) * np.finfo(float).eps * np.sqrt((g * g).sum(1).max()) * np.sqrt((p * p).sum(1)) if exact else None
    for at in range(0, len(p), step := max(1, SLAB // len(g))):
        some = p[at : at + step]
        if exact and np.isfinite(slack[at : at + step]).all():
            s = some @ g.T
            i, j = np.nonzero(s >= (s.max(1) - slack[at : at + step])[:, None])
        else:
            i, j = (x.ravel() for x in np.indices((len(some), len(g))))
        t = np.zeros(len(i))
        with np.errstate(invalid="ignore", over="ignore"):
            for k in range(p.shape[1]):
                t += some[i, k] * g[j, k]
        i, j, t = (x[t > -np.inf] for x in (i, j, t))  # neither NaN
        by = np.lexsort((order[j], -t, i))
        own, first = np.unique(i[by], return_index=True)
        best[at + own], score[at + own] = j[by][first], t[by][first]
    return best, score


def identify(probes: DataFrame, gallery: DataFrame, threshold: float = 0.363, probe_id: str = "probe_id", vector: str = "v", name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """(probe_id, name, score): the gallery sample with the largest inner product, the first on ties.

    Under the threshold the name is Unknown and the score max(score, 0). Probes and gallery are cut into blocks of bounded
    size, and a task takes one of each; a block gives one row a probe.
    """
    cut = lambda d: max(1, -(-d.count() // BLOCK))
    asked, known = probes.count(), cut(gallery)
    parts = max(1, -(-asked // BLOCK), min(LEAST_BLOCKS, -(-asked // SMALL_BLOCK)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    double = F.col(vector).cast("array<double>").alias("v")
    kinds = {"p": probes.schema[probe_id].dataType.simpleString(), "n": gallery.schema[name].dataType.simpleString()}
    empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    left = probes.select(block(probe_id, parts).alias("i"), every(known).alias("j"), F.col(probe_id).alias("p"), empty("n"), F.lit(None).cast("bigint").alias("o"), double, F.lit(False).alias("known"))
    right = gallery.select(every(parts).alias("i"), block(ordinal, known).alias("j"), empty("p"), F.col(name).alias("n"), F.col(ordinal).cast("bigint").alias("o"), double, F.lit(True).alias("known"))

    def run(t: pa.Table) -> pa.Table:
        of = t.column("known").to_numpy()
        p, g = (t.take(pa.array(np.flatnonzero(x))) for x in (~of, of))
        pv, ps, pok = dense(p.column("v").combine_chunks())
        gv, gs, gok = dense(g.column("v").combine_chunks())
        order, best, score = g.column("o").to_numpy(), np.full(len(pv), -1), np.full(len(pv), -np.inf)
        for size in np.unique(ps[pok]):
            i, j = np.flatnonzero(pok & (ps == size)), np.flatnonzero(gok & (gs == size))
            at, score[i] = _best(pv[i, :size], gv[j, :size], order[j])
            best[i[at >= 0]] = j[at[at >= 0]]
        if not len(gv):  # nobody to meet
            best = best[:0]
            p = p.slice(0, 0)
            score = score[:0]
        found = pa.array(best, mask=best < 0)
        return pa.table({"p": p.column("p"), "s": pa.array(score), "o": g.column("o").take(found), "n": g.column("n").take(found)})

    met = left.unionByName(right).groupBy("i", "j").applyInArrow(run, f"p {kinds['p']}, s double, o bigint, n {kinds['n']}")
    top = met.groupBy(F.col("p").alias(probe_id)).agg(F.max_by(F.struct("s", "o", "n"), F.struct(F.col("s"), -F.col("o"))).alias("b"))
    hit = F.col("b.s") >= threshold
    return top.select(probe_id, F.when(hit, F.col("b.n")).otherwise("Unknown").alias("name"), F.when(hit, F.col("b.s")).otherwise(F.greatest("b.s", F.lit(0.0))).alias("score"))


def votes(seen: DataFrame, track: str = "track", name: str = "name", score: str = "score", order: str = "event_id", least: int = 3) -> DataFrame:
    """(track, name, best): the name with most votes, then the largest sum of scores, then seen first; null under `least` votes."""
    per = seen.groupBy(track, name).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.min(order).alias("first"), F.max(score).alias("top"))
    best = per.groupBy(track).agg(F.max_by(F.struct(name, "n", "top"), F.struct("n", "s", -F.col("first"))).alias("b"))
    won = F.col("b.n") >= least
    return best.select(track, F.when(won, F.col(f"b.{name}")).alias("name"), F.when(won, F.col("b.top")).otherwise(0.0).alias("best"))


def faces_in_boxes(faces: DataFrame, people: DataFrame, image: str = "image") -> DataFrame:
    """(image, face, person): each face's centre (cx, cy) in the smallest person box that holds it, edges included, the first on ties."""
    inside = (F.col("cx") >= F.col("x1")) & (F.col("cx") <= F.col("x2")) & (F.col("cy") >= F.col("y1")) & (F.col("cy") <= F.col("y2"))
    met = faces.join(people, image).where(inside)
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return met.groupBy(image, "face").agg(F.min_by("person", F.struct(size.alias("area"), F.col("person"))).alias("person"))


def identity_metrics(rows: DataFrame, key: str, order: str = "sequence_number", visible: str = "target_visible", track: str = "assigned_track_id", unmatched: str = "unmatched_track_count") -> DataFrame:
    """Per key: visible_frames, assigned_frames, missed_frames, coverage, fragmentations, identity_switches, distinct_ids, unmatched_tracks.

    An episode is a run of visible rows. A switch is an id other than the episode's last one; a fragmentation is an id
    after an unassigned row of an episode that had one. Keys without visible rows have no coverage.
    """
    w = Window.partitionBy(key).orderBy(order)
    t = rows.withColumn("_episode", F.sum((~F.col(visible)).cast("int")).over(w)).withColumn("_id", F.when(F.col(visible), F.col(track)))
    e = Window.partitionBy(key, "_episode", visible).orderBy(order)
    t = t.withColumn("_before", F.last("_id", ignorenulls=True).over(e.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_prev", F.lag("_id").over(e))
    had = F.col("_id").isNotNull() & F.col("_before").isNotNull()
    out = t.groupBy(key).agg(
        F.count_if(visible).alias("visible_frames"), F.count("_id").alias("assigned_frames"), F.count_if(had & F.col("_prev").isNull()).alias("fragmentations"), F.count_if(had & (F.col("_before") != F.col("_id"))).alias("identity_switches"),
        F.countDistinct("_id").alias("distinct_ids"), F.sum(unmatched).alias("unmatched_tracks"),
    )
    return out.withColumn("missed_frames", F.col("visible_frames") - F.col("assigned_frames")).withColumn("coverage", F.try_divide("assigned_frames", "visible_frames"))
