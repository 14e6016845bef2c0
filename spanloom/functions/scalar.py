"""Pure column expressions: time codes, geometry, priorities, bands, text scores and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frame-rate standards and the half-open ranges that stand for them.
FPS_STANDARDS = (
    (23.976, 23.9, 24.0),
    (24.0, 23.99, 24.01),
    (25.0, 24.99, 25.01),
    (29.97, 29.9, 30.0),
    (30.0, 29.99, 30.01),
    (47.952, 47.9, 48.0),
    (48.0, 47.99, 48.01),
    (50.0, 49.99, 50.01),
    (59.94, 59.9, 60.0),
    (60.0, 59.99, 60.01),
    (119.88, 119.8, 120.0),
    (120.0, 119.99, 120.01),
)
# Operation weights, and the words that open a question of each kind.
OPERATION_WEIGHT = {"TRACK_OBJECT": 3.0, "SEGMENT_OBJECT_AT": 3.0, "GET_PROPERTIES": 2.0, "ZOOM_IN": 2.0, "READ_TEXT": 1.0, "THINK": 0.5}
QUESTION_WORDS = ("what", "who", "where", "when", "why", "how")


def chain(cases: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for when, value in reversed(cases):
        out = F.when(when, value).otherwise(out)
    return out


def frame_at(seconds: Column, fps: Column, mode: str = "round") -> Column:
    """The frame at a time; null for negative times and rates that aren't positive."""
    x = seconds * fps
    frame = {"round": F.bround(x), "floor": F.floor(x), "ceil": F.ceil(x)}[mode].cast("long")
    return F.when((seconds >= 0) & (fps > 0), frame)


def time_at(frame: Column, fps: Column) -> Column:
    """The time of a frame."""
    return F.when((frame >= 0) & (fps > 0), frame / fps)


def parse_time(text: Column) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``; null for anything else."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: x.try_cast("double"))
    seconds = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.size(parts).between(1, 3), seconds)


def standard_fps(fps: Column) -> Column:
    """The frame-rate standard near a measured rate, or the rate itself."""
    return chain([((fps >= low) & (fps < high), value) for value, low, high in FPS_STANDARDS], fps)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes ``x1, y1, x2, y2``."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(both, F.nullif(area(a) + area(b) - both, F.lit(0.0))), F.lit(0.0))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height, 0 where there is no height."""
    return F.when(height > 0, width / height).otherwise(0.0)


def size_band(share: Column) -> Column:
    """The size category of an object's share of the image."""
    return chain([(share < 0.01, "tiny"), (share < 0.05, "small"), (share < 0.2, "medium"), (share < 0.5, "large")], "very_large")


def quadrant(x: Column, y: Column) -> Column:
    """The quarter of the unit square a point is in."""
    return F.concat_ws("_", F.when(y < 0.5, "top").otherwise("bottom"), F.when(x < 0.5, "left").otherwise("right"))


def priority(uncertainty: Column, reward: Column, age_hours: Column) -> Column:
    """Priority that decays by the hour."""
    return (0.5 * uncertainty + 0.5 * F.abs(reward)) * F.pow(F.lit(0.95), age_hours)


def initial_priority(uncertainty: Column, reward: Column) -> Column:
    """Priority of a new row."""
    return F.greatest(0.4 * uncertainty + 0.4 * F.abs(reward), F.lit(0.01))


def success_rate(good: Column, all_: Column) -> Column:
    """Successes over tries, 0 without tries."""
    return F.when(all_ > 0, good / all_).otherwise(0.0)


def vote_weight(confidence: Column, rate: Column, age_hours: Column, priority_: Column) -> Column:
    """The weight of a neighbour's vote by confidence, success, age and priority."""
    success = F.when(rate > 0, 0.5 + 0.5 * rate).otherwise(1.0)
    return confidence * success * F.exp(-age_hours / 24) * (0.5 + 0.5 * F.least(priority_, F.lit(2.0)) / 2)


def agreement_factor(ratio: Column) -> Column:
    """Piecewise linear in the share of votes that agree; the pieces don't meet at 0.3."""
    piece = F.when(ratio > 0.7, 0.8 + 0.2 * (ratio - 0.7) / 0.3).when(ratio < 0.3, 0.6 + 0.2 * ratio / 0.3).otherwise(0.6 + 0.2 * (ratio - 0.3) / 0.4)
    return F.least(F.greatest(piece, F.lit(0.5)), F.lit(1.0))


def question_type(text: Column) -> Column:
    """The kind of a question by its first word."""
    low = F.lower(text)
    return chain([(low.startswith(w), w) for w in QUESTION_WORDS] + [(low.contains("what happens"), "event")], "other")


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def character_error(prediction: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; 0 or 1 for an empty truth."""
    return F.when(F.length(truth) > 0, F.levenshtein(prediction, truth) / F.length(truth)).otherwise(F.when(F.length(prediction) > 0, 1.0).otherwise(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """Edit distance over the longer length, 0 for two empty texts."""
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def length_complexity(n: Column) -> Column:
    """Logarithmic length score of a trajectory."""
    return F.when(n < 2, 0.1).otherwise(F.least(F.log(n + 1.0) / F.log(F.lit(16.0)), F.lit(1.0)))


def operation_weight(op: Column) -> Column:
    """The fixed weight of an operation, null for unknown ones."""
    return chain([(op == name, weight) for name, weight in OPERATION_WEIGHT.items()], F.lit(None).cast("double"))


def reasoning_depth(thinking: Column, steps: Column) -> Column:
    """Score of the share of thinking steps, best between 0.2 and 0.6."""
    ratio = thinking / steps
    return F.when(steps == 0, 0.0).otherwise(F.when(ratio < 0.2, ratio / 0.2).when(ratio > 0.6, 1.0 - (ratio - 0.6) / 0.4 * 0.3).otherwise(1.0))


def effect_label(d: Column) -> Column:
    """The name of an effect size."""
    return chain([(F.abs(d) < 0.2, "negligible"), (F.abs(d) < 0.5, "small"), (F.abs(d) < 0.8, "medium")], "large")


def trend_label(slope: Column, flat: float = 0.01) -> Column:
    """Improving, stable or declining by slope."""
    return F.when(F.abs(slope) < flat, "stable").when(slope > 0, "improving").otherwise("declining")


def beyond(value: Column, threshold: Column, comparison: Column) -> Column:
    """A threshold predicate by the name of its comparison; unknown names never hold."""
    return F.coalesce(chain([(comparison == "gt", value > threshold), (comparison == "lt", value < threshold), (comparison == "eq", value == threshold), (comparison == "gte", value >= threshold), (comparison == "lte", value <= threshold)], False), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, null where one is zero."""
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))
