"""Detection and redaction of personal data by a catalog of patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, pattern, replacement and risk of each category, in the order of redaction.
CATALOG = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL", "high"),
    ("phone", r"(\+\d{1,3}[-.\s]?)?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}", "PHONE", "high"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b", "SSN", "high"),
    ("credit_card", r"\b(?:\d[ -]*?){13,16}\b", "CREDIT_CARD", "high"),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b|(?:[A-F0-9]{1,4}:){7}[A-F0-9]{1,4}", "IP_ADDRESS", "medium"),
    ("mac_address", r"([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})", "MAC_ADDRESS", "low"),
    ("personal_url", r"https?://[^\s]*(?:profile|user|account|id|uid|member)/[^\s]+", "PERSONAL_URL", "medium"),
    ("social_handle", r"@[A-Za-z0-9_]{1,15}\b", "SOCIAL_HANDLE", "low"),
    ("date_of_birth", r"\b(?:0[1-9]|1[0-2])[/\-.](?:0[1-9]|[12][0-9]|3[01])[/\-.](?:19|20)\d{2}\b", "DATE_OF_BIRTH", "medium"),
    ("bank_account", r"\b[0-9]{8,17}\b", "ACCOUNT_NUMBER", "high"),
    ("passport", r"\b[A-Z]{1,2}[0-9]{6,9}\b", "PASSPORT", "high"),
    ("drivers_license", r"\b[A-Z]{1,2}[0-9]{5,8}\b", "LICENSE_NUMBER", "high"),
    ("medical_record", r"\bMRN[:\s]?[0-9]{6,10}\b", "MEDICAL_RECORD", "high"),
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", "AWS_KEY", "high"),
    ("api_key", r"\b[a-zA-Z0-9]{32,}\b", "API_KEY", "high"),
)
FLAGS = "(?im)"
RISK = {"high": 10, "medium": 5, "low": 1}


def count(text: Column, name: str) -> Column:
    """How often a category's pattern matches."""
    pattern = next(p for n, p, _, _ in CATALOG if n == name)
    return F.coalesce(F.regexp_count(text, F.lit(FLAGS + pattern)), F.lit(0))


def redact(text: Column, marker=lambda label: f"[{label}]") -> Column:
    """``text`` with every category replaced in the catalog's order, each in what the ones before left."""
    for _, pattern, label, _ in CATALOG:
        text = F.regexp_replace(text, F.lit(FLAGS + pattern), F.lit(marker(label)))
    return text


def risk(counts: dict[str, Column]) -> tuple[Column, Column]:
    """Risk points of category counts, and their level."""
    points = sum(counts[n] * RISK[r] for n, _, _, r in CATALOG if n in counts)
    level = F.when(points == 0, "none").when(points < 10, "low").when(points < 50, "medium").otherwise("high")
    return points, level


def user_hash(user: Column) -> Column:
    """A user's pseudonym: the first 16 digits of the SHA-256 of the id."""
    return F.substring(F.sha2(user.cast("string"), 256), 1, 16)


def redact_hashed(text: Column, digits: int = 6) -> Column:
    """``text`` with every category replaced by its name and the first digits of the match's MD5 digest.

    A category reads what the ones before left; what lies between matches and the matches' markers are put
    together again, so no match is looked up.
    """
    for _, pattern, label, _ in CATALOG:
        text = F.element_at(F.transform(F.array(text), _hashed(FLAGS + pattern, label, digits)), 1)  # bound once, as it is read twice
    return text


def _hashed(pattern: str, label: str, digits: int) -> Callable[[Column], Column]:
    """What replaces a pattern's matches in a text."""

    def body(text: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.concat(F.lit(f"[{label}_"), F.substring(F.md5(m), 1, digits), F.lit("]")))
        between = F.split(text, pattern, -1)
        return F.array_join(F.zip_with(between, F.concat(marks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return body


def verify_anonymised(texts: dict[str, Column], forbidden: list[Column], flag: Column) -> Column:
    """What is wrong with an anonymised row: texts with personal data, fields that should be gone, no mark."""
    found = [F.when(sum((count(c, n) for n, *_ in CATALOG if n not in ("phone", "bank_account")), F.lit(0)) > 0, F.lit(f"personal data in {name}")) for name, c in texts.items()]
    found += [F.when(c.isNotNull(), F.lit("forbidden field")) for c in forbidden]
    found.append(F.when(~F.coalesce(flag, F.lit(False)), F.lit("not marked")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())
