"""Column expressions over text: tokens, anchored identifiers, citations, truncation, answers and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The identifier and token grammars of the claims domain.
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)?"
CLAIM_NUMBER = r"^CLM-\d{4}-\d{5}$"
FORM_NUMBER = r"^NG-\d{4}$"
EXACT_CODE = r"\b[eE]-\d{1,3}\b"
CLAIM_IN_TEXT = r"\bCLM-\d{4}-\d{5}\b"
EXCLUSION_IN_TEXT = r"\bE-\d{2}\b"
DENIAL = r"(?i)\b(denied|denial|declined|not covered|excluded|not payable)\b"
NON_BREAKING_HYPHEN = "‑"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits with at most one hyphen inside; of null an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stripped(text: Column) -> Column:
    """White space of every kind taken off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_claim_number(value: Column) -> Column:
    return F.coalesce(value.rlike(CLAIM_NUMBER), F.lit(False))


def is_form_number(value: Column) -> Column:
    return F.coalesce(value.rlike(FORM_NUMBER), F.lit(False))


def is_refusal(answer: Column) -> Column:
    return F.coalesce(stripped(answer).startswith("REFUSAL:"), F.lit(False))


def truncated(text: Column, size: int = 300, suffix: str = "...") -> Column:
    """At most ``size`` characters, with ``suffix`` only where something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(suffix))).otherwise(text)


def passage(text: Column, size: int = 900) -> Column:
    """Without the first line, at most ``size`` characters; a text of one line stays whole."""
    return F.substring(F.regexp_replace(text, r"^[^\n]*\n", ""), 1, size)


def citations(text: Column, opening: str = r"\[SOURCE:", stop: str = r"\]", bar: str = r"\|") -> Column:
    """What stands between ``opening`` and ``stop``, up to a bar, trimmed: each once, in order, none empty."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{opening}([^{stop}]*){stop}"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.trim(F.split(x, bar)[0]))), lambda x: x != "")


def exact_codes(question: Column, pattern: str = EXACT_CODE) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(pattern), F.lit(0)), F.upper))


def contains_any(text: Column, codes: Column) -> Column:
    """Any code is a substring of the text, whatever the case (E-4 is in E-41)."""
    return F.exists(codes, lambda c: F.contains(F.upper(text), F.upper(c)))


def normal_reference(reference: Column) -> Column:
    """A reference without non-breaking hyphens, form prefix and the word CLAUSE."""
    plain = F.trim(F.replace(reference, F.lit(NON_BREAKING_HYPHEN), F.lit("-")))
    return F.regexp_replace(F.regexp_replace(plain, r"^NG-\d{4}\s*[:/ ]\s*", ""), r"(?i)^CLAUSE[-\s]+", "")


def suggested_wait(message: Column, slack: float = 1.0, most: float = 120.0) -> Column:
    """Seconds from ``try again in 1m2.5s``, plus ``slack``, at most ``most``; null where nothing is suggested."""
    pattern = r"try again in (?:(\d+)m)?(\d+(?:\.\d+)?)s"
    minutes, seconds = F.regexp_extract(message, pattern, 1), F.regexp_extract(message, pattern, 2)
    total = F.coalesce(F.when(minutes != "", minutes).cast("double"), F.lit(0.0)) * 60 + F.when(seconds != "", seconds).cast("double")
    return F.least(total + slack, F.lit(most))


def is_quota_error(error: Column) -> Column:
    return F.coalesce(F.contains(F.lower(error), F.lit("quota")) | F.contains(F.lower(error), F.lit("tokens per day")), F.lit(False))


def json_object(text: Column, schema: T.StructType | str) -> Column:
    """The object from the first ``{`` to the last ``}``; null where that is no JSON object."""
    return F.from_json(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), F.lit("")), schema)


def verdict(text: Column) -> Column:
    """PASS or FAIL: a JSON ``verdict`` first, else PASS only if the text has PASS and not FAIL."""
    said = F.upper(json_object(text, "verdict string")["verdict"])
    bare = F.when(F.contains(F.upper(text), F.lit("PASS")) & ~F.contains(F.upper(text), F.lit("FAIL")), "PASS").otherwise("FAIL")
    return F.when(said.isin("PASS", "FAIL"), said).otherwise(bare)


def handoff_group(name: Column, lap: Column | None = None) -> Column:
    """A hand-off without its lap; with ``lap``, later laps are a group of their own."""
    group = F.split(name, r" \(lap")[0]
    return group if lap is None else F.concat(group, F.when(lap == 1, " 1").otherwise(" 2+"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over ``n`` tokens; the last is the first that reaches the end; none over no tokens."""
    stride = size - overlap
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / stride).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def ordered_flags(pairs: Sequence[tuple[str, Column]]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
