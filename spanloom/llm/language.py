"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (1 to 3 letters, words padded by one blank) of a language in
order of frequency.  A document's own list is compared with each profile: every n-gram of the document
costs the difference of its two places, or the profile's length if it isn't there.  The language of the
least total is the prediction, and the score is 1 less the mean cost as a share of the largest cost.

Profiles are fitted on at most ``docs_per_lang`` different labelled texts of each language, those of the
smallest hash of the text.  How many texts have a hash with so many leading zeros is counted first; it
gives each language a bound, and only texts below it (about as many as are wanted) are shuffled.

Defined cases: texts that are null or hold no letter are ``und`` with score 0, and so is everything if
nothing was labelled; equal texts get equal answers; of languages at equal distance the first by code
point wins; n-grams of equal frequency are in order of their code points.  Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .units import settle

PROFILE = 400
DOC_GRAMS = 300
DOCS_PER_LANG = 1000
UNKNOWN = "und"
#: Letters turned into n-grams at a time, which bounds the memory a long text takes.
CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the code point of its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram codes of a text in order, and how often each occurs.

    Runs of other signs than letters are one blank.  A text is taken ``CHUNK`` signs at a time, each with
    the last two signs of what came before, so memory doesn't grow with its length.
    """
    codes, counts = [], []
    tail, last = np.zeros(1, dtype=np.uint64), np.uint64(0)

    def add(fresh: np.ndarray) -> None:
        nonlocal tail
        x, k = np.concatenate([tail, fresh]), len(tail)
        one = fresh[fresh != 0]
        two = (x[:-1] << np.uint64(21) | x[1:])[k - 1 :] | np.uint64(1 << 43)
        middle = x[1:-1] != 0
        three = (x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:])[max(0, k - 2) :][middle[max(0, k - 2) :]] | np.uint64(1 << 63)
        both = np.sort(np.concatenate([one, two, three]))
        if len(both):
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            codes.append(both[first])
            counts.append(np.diff(np.append(first, len(both))))
        tail = x[-2:]

    for lo in range(0, len(text), CHUNK):
        letters = _letters()[np.frombuffer(text[lo : lo + CHUNK].encode("utf-32-le", "replace"), dtype="<u4")]
        before = np.concatenate([[last], letters[:-1]])
        last = letters[-1]
        add(letters[(letters != 0) | (before != 0)])
    if tail[-1]:
        add(np.zeros(1, dtype=np.uint64))
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    both, place = np.unique(np.concatenate(codes), return_inverse=True)
    return both, np.bincount(place, weights=np.concatenate(counts), minlength=len(both)).astype(np.int64)


@dataclass
class Profiles:
    """The places of n-grams in the languages' profiles."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and the score."""
        codes, counts = gram_counts(text or "")
        if not self.langs or not len(counts) or codes[0] >= np.uint64(1 << 43):  # no single letter
            return UNKNOWN, 0.0
        top = codes[np.argsort(-counts, kind="stable")[:DOC_GRAMS]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        here = self.codes[at] == top
        apart = np.abs(self.ranks[at] - np.arange(len(top))[:, None])
        cost = np.where(here[:, None] & (self.ranks[at] < PROFILE), np.minimum(apart, PROFILE), PROFILE).sum(axis=0)
        best = int(np.argmin(cost))
        return self.langs[best], 1 - float(cost[best]) / (PROFILE * len(top))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, profile: int = PROFILE) -> Profiles:
    """Profiles from rows with a language; what reaches the driver is ``profile`` rows per language."""
    # Hashes of 63 bits; a level is the number of their leading zeros.
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    level = F.lit(63) - F.length(F.bin("h"))
    counts = rows.select("lang", "h", level.alias("level")).groupBy("lang", "level").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    upto = Window.partitionBy("lang").orderBy(F.desc("level"))  # at most 64 rows a language
    enough = counts.withColumn("all", F.sum("n").over(upto)).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("all") >= 1.2 * docs_per_lang, F.col("level"))), F.lit(-1)).alias("least"))
    bounds = {r["lang"]: r["least"] for r in enough.collect()}  # one row a language
    wanted = F.lit(False)
    for name, least in bounds.items():
        wanted = wanted | ((F.col("lang") == name) & (level >= least))
    near = rows.filter(wanted).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    sample = near.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= docs_per_lang).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(name, []).append(gram_counts(t))
        for name, lists in found.items():
            codes, place = np.unique(np.concatenate([c for c, _ in lists]), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate([x for _, x in lists]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Codes with the highest bit are negative as longs and come last, as they do unsigned.
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    rows = grams.withColumn("at", F.row_number().over(frequent)).filter(F.col("at") <= profile).select("lang", "gram", "at").collect()
    langs = sorted({r["lang"] for r in rows})
    codes = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64).view(np.uint64))
    ranks = np.full((len(codes), len(langs)), profile, dtype=np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, np.int64(r["gram"]).view(np.uint64)), langs.index(r["lang"])] = r["at"] - 1
    return Profiles(langs, codes, ranks)


def identify(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    rows = df.select(*[f"`{c}`" for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [profiles.predict(t.as_py()) for t in part.column(kept.index(text))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*kept, "lang_pred", "score"])
        settle()

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
