"""Texts of traces and answers: parsing, formatting, error rates, keys."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import chain, words

#: Operations that a line of a trace may name, in the order in which they are looked for (fixed values).
OPERATIONS = ("SEGMENT_OBJECT_AT", "READ_TEXT", "GET_PROPERTIES", "TRACK_OBJECT", "ZOOM_IN", "THINK")


def _word_distance(a: list, b: list) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def word_error(prediction: Column, truth: Column) -> Column:
    """Edit distance between words over the number of the truth's words; 0 or 1 for an empty truth."""

    @F.pandas_udf("double")
    def run(p: pd.Series, t: pd.Series) -> pd.Series:
        rate = lambda a, b: _word_distance(a, b) / len(b) if b else float(bool(a))
        return pd.Series([rate((a or "").split(), (b or "").split()) for a, b in zip(p, t, strict=True)], dtype="float64")

    return run(prediction, truth)


def ocr_score(prediction: Column, truth: Column) -> Column:
    """1 for equal texts, 0.5 for texts that are equal but for case, else 0."""
    return F.when(prediction == truth, 1.0).when(F.lower(prediction) == F.lower(truth), 0.5).otherwise(0.0)


def fuzzy_reward(answer: Column, truth: Column) -> Column:
    """1 for equal answers, else half of the Ratcliff-Obershelp ratio of the lower-cased texts."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        one = lambda x, y: 0.0 if x is None or y is None else 1.0 if x == y else 0.5 * SequenceMatcher(None, x.lower(), y.lower()).ratio()
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(answer, truth)


def mean_words(texts: Column) -> Column:
    """The mean number of words of an array of texts, to two digits; 0 without texts."""
    total = F.aggregate(texts, F.lit(0), lambda a, t: a + F.size(words(t)))
    return F.when(F.size(texts) > 0, F.bround(total / F.size(texts), 2)).otherwise(0.0)


def complexity(n: Column, distinct: Column, has_text: Column) -> Column:
    """Score of a web task by the number of its actions, their kinds and whether any has text."""
    return F.bround(F.least(n * 0.1 + distinct * 0.2 + F.when(has_text, 0.3).otherwise(0.0), F.lit(1.0)), 3)


def answer(response: Column) -> Column:
    """What stands between the first ``<answer>`` and its end, or else the last line."""
    inside = F.regexp_extract(response, r"(?s)<answer>(.*?)</answer>", 1)
    return F.trim(F.when(response.rlike(r"(?s)<answer>.*?</answer>"), inside).otherwise(F.element_at(F.split(response, "\n"), -1)))


def operation(line: Column, names: Sequence[str] = OPERATIONS) -> Column:
    """The first of the operations, in their order, that a line names; null for none."""
    return chain([(line.contains(n), n) for n in names], F.lit(None).cast("string"))


def steps(response: Column, names: Sequence[str] = OPERATIONS) -> Column:
    """The operations of a response's lines, with their kind."""
    ops = F.filter(F.transform(F.split(response, "\n"), lambda s: operation(s, names)), lambda o: o.isNotNull())
    return F.transform(ops, lambda o: F.struct(o.alias("operation"), F.when(o == "THINK", "reasoning").otherwise("visual").alias("type")))


def prompt(question: Column, actions: Column, final: Column) -> Column:
    """A sample as text: question, numbered steps, answer."""
    numbered = F.array_join(F.transform(actions, lambda a, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), a)), "\n")
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), numbered, F.concat(F.lit("Answer: "), final))


def error_text(task: Column, error: Column, context: Column, tools: Column) -> Column:
    """A failed case as text: task, error, the first 200 signs of its context, its first five tools."""
    return F.concat_ws(" | ", F.concat(F.lit("task: "), task), F.concat(F.lit("error: "), error), F.concat(F.lit("context: "), F.substring(context, 1, 200)), F.concat(F.lit("tools: "), F.array_join(F.slice(tools, 1, 5), ",")))


def corrupted(text: Column, level: float, key: Column, seed: int = 7) -> Column:
    """``text`` with a share of its letters doubled, dropped or replaced, by a digest of key and place."""
    u = lambda i, salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), key.cast("string"), i.cast("string"))), 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24))
    one = lambda c, i: F.when(u(i, "a") >= level, c).when(u(i, "b") < 0.33, F.concat(c, c)).when(u(i, "b") < 0.66, F.lit("")).otherwise(F.chr((97 + F.floor(u(i, "c") * 26)).cast("int")))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def canonical(**fields: Column) -> Column:
    """A JSON object with sorted keys, ``", "`` and ``": "`` between, of texts and numbers; nulls are ``null``."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"([\\\\\"])", r"\\$1"), "\n", r"\\n"), F.lit('"'))
    parts = [F.concat(F.lit(f'"{n}": '), F.coalesce(quote(c), F.lit("null"))) for n, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def content_id(prefix: str = "", digits: int = 12, algorithm: str = "sha256", **fields: Column) -> Column:
    """An id from the digest of the fields' canonical JSON."""
    raw = canonical(**fields)
    digest = F.sha2(raw, 256) if algorithm == "sha256" else F.md5(raw)
    return F.concat(F.lit(prefix), F.substring(digest, 1, digits))


def filled(templates: Sequence[str], key: Column, **values: Column) -> Column:
    """One of the templates, by a digest of the key, with ``{name}`` replaced by values."""
    at = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % len(templates)
    text = F.element_at(F.array(*map(F.lit, templates)), (at + 1).cast("int"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def mean_and_std(mean: Column, std: Column, digits: int = 3) -> Column:
    """``mean +- std`` with a fixed number of digits, and stars are the caller's."""
    return F.concat(F.format_string(f"%.{digits}f", mean), F.lit(" ± "), F.format_string(f"%.{digits}f", std))


def stars(p: Column) -> Column:
    """Stars of significance."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def appropriate(text: Column, blocked: Sequence[str], most: int = 5000) -> Column:
    """Whether a text is short enough and holds no blocked words."""
    bad = F.lit(False)
    for word in blocked:
        bad = bad | F.lower(text).contains(word)
    return (F.length(text) <= most) & ~bad


def subsequence(tokens: Column, wanted: Column) -> Column:
    """The first place (from 1) at which lower-cased tokens hold the wanted words in a row; null if nowhere."""
    low = F.transform(tokens, F.lower)
    n = F.size(wanted)
    starts = F.when((n > 0) & (F.size(tokens) >= n), F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(starts, lambda i: (F.get(low, i - 1) == F.get(wanted, F.lit(0))) & (F.slice(low, i, n) == wanted)), F.lit(0))


def property_matches(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """Whether two property values agree: numbers within a relative tolerance, texts but for case and blanks; a missing one never does."""
    x, y = a.try_cast("double"), b.try_cast("double")
    numbers = F.when(y == 0, x == 0).otherwise(F.abs(x - y) / F.abs(y) < tolerance)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), numbers).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b))), F.lit(False))
