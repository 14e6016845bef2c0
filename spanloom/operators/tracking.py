"""Frame-by-frame assignment of predicted to true boxes, and what trackers are measured by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of least total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        match[0], free = row, 0
        least, back, seen = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[free]:
            seen[free] = True
            gap = c[match[free] - 1] - u[match[free]] - v[1:]
            better = ~seen[1:] & (gap < least[1:])
            least[1:][better], back[1:][better] = gap[better], free
            nxt = int(np.argmin(np.where(seen, np.inf, least)))
            step = least[nxt]
            u[match[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            free = nxt
        while free:
            match[free], free = match[back[free]], back[free]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda x: (x[:, 2:] - x[:, :2]).prod(axis=1)
    whole = size(a)[:, None] + size(b)[None] - both
    return np.divide(both, whole, out=np.zeros_like(both), where=whole > 0)


def matches(boxes: DataFrame) -> DataFrame:
    """``sequence, frame, true_id, pred_id, iou`` of ``sequence, frame, side, id, x1, y1, x2, y2`` by least cost per frame.

    A frame is one row of boxes, so that many small frames share an Arrow batch.
    """
    box = F.struct((F.col("side") == "gt").alias("true"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    frames = boxes.filter("side IN ('gt', 'pred')").groupBy(F.col("sequence").cast("long").alias("sequence"), F.col("frame").cast("long").alias("frame")).agg(F.collect_list(box).alias("boxes"))

    def run(batches):
        for batch in batches:
            ends, parts = batch.column("boxes").offsets.to_numpy(), batch.column("boxes").values.flatten()
            true, ids, *corners = [p.to_numpy(zero_copy_only=False) for p in parts]
            corners = np.column_stack(corners)
            out = []
            for k, (sequence, frame) in enumerate(zip(batch.column("sequence").to_pylist(), batch.column("frame").to_pylist())):
                at = np.arange(ends[k], ends[k + 1])
                left, right = at[true[at].astype(bool)], at[~true[at].astype(bool)]
                if len(left) and len(right):
                    share = _iou(corners[left], corners[right])
                    out += [(sequence, frame, int(ids[left[i]]), int(ids[right[j]]), float(share[i, j])) for i, j in assign(1 - share)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names, types = ["sequence", "frame", "true_id", "pred_id", "iou"], [pa.int64()] * 4 + [pa.float64()]
    return frames.mapInArrow(run, "sequence long, frame long, true_id long, pred_id long, iou double")


def scores(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """``sequence, n_true, misses, extra, switches, mota, motp`` of matches at a least overlap."""
    from pyspark.sql import Window

    good = matches(boxes).filter(F.col("iou") >= least)
    before = F.lag("pred_id").over(Window.partitionBy("sequence", "true_id").orderBy("frame"))
    per = good.withColumn("switch", F.coalesce(before != F.col("pred_id"), F.lit(False))).groupBy("sequence").agg(F.count("*").alias("hits"), F.count_if("switch").alias("switches"), F.avg("iou").alias("motp"))
    n = boxes.groupBy("sequence").agg(F.count_if(F.col("side") == "gt").alias("n_true"), F.count_if(F.col("side") == "pred").alias("n_pred"))
    j = n.join(per, "sequence", "left").fillna(0, ["hits", "switches"])
    out = j.withColumn("misses", F.col("n_true") - F.col("hits")).withColumn("extra", F.col("n_pred") - F.col("hits"))
    mota = F.try_divide(F.col("n_true") - F.col("misses") - F.col("extra") - F.col("switches"), F.col("n_true"))
    return out.select("sequence", "n_true", "misses", "extra", "switches", mota.alias("mota"), F.coalesce("motp", F.lit(0.0)).alias("motp"))
