"""Claim rules: estimates, payouts, grades of answers, and assertions about summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import CLAIM_IN_TEXT, DENIAL, EXCLUSION_IN_TEXT, NON_BREAKING_HYPHEN

# The statuses a claim can have, and how dates and amounts are written in summaries.
STATUSES = ("covered", "covered_subject_to_sublimit", "excluded")
BASES = ("all_peril", "hurricane", "none_scheduled_article")
HURRICANE_SHARE = 0.02
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DATES = (
    (r"\b\d{4}-\d{2}-\d{2}\b", ("yyyy-MM-dd",)),
    (r"\b\d{1,2}/\d{1,2}/\d{4}\b", ("M/d/yyyy", "d/M/yyyy")),
    (rf"(?i)\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b", ("MMM d yyyy",)),
    (rf"(?i)\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b", ("d MMM yyyy",)),
)
AMOUNT = r"\$?\s?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d+(?:\.\d{2})?)"
EXCESS_AFTER = rf"(?i)(?:deductible|excess)[^$\d\n.,;]{{0,25}}{AMOUNT}"
EXCESS_BEFORE = rf"(?i){AMOUNT}\s*(?:[\w‐-―-]+\s+){{0,2}}(?:deductible|excess)"


def estimate(lines: Column, amount: str = "amount") -> Column:
    """The sum of a claim's lines; null, not 0, where there are none."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.aggregate(lines, F.lit(0.0), lambda s, x: s + x[amount].cast("double")))


def payout(known: Column, status: Column, amount: Column, basis: Column, all_peril: Column, coverage_a: Column, sublimit: Column) -> Column:
    """``struct(payable, deductible, error)``: checks in a fixed order, errors as values; the cap is after the
    deductible and only for claims subject to a sublimit."""
    error = (
        F.when(~known, "unknown claim")
        .when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "unknown status")
        .when((status == STATUSES[1]) & sublimit.isNull(), "sublimit required")
        .when((status != STATUSES[2]) & ~F.coalesce(basis.isin(*BASES), F.lit(False)), "unknown basis")
    )
    deductible = F.when(basis == BASES[0], all_peril.cast("double")).when(basis == BASES[1], F.round(HURRICANE_SHARE * coverage_a, 2)).otherwise(0.0)
    net = F.greatest(F.lit(0.0), amount.cast("double") - deductible)
    net = F.when((status == STATUSES[1]) & (net > sublimit), sublimit.cast("double")).otherwise(net)
    fine = error.isNull()
    excluded = status == STATUSES[2]
    return F.struct(F.when(fine & excluded, 0.0).when(fine, F.round(net, 2)).alias("payable"), F.when(fine & ~excluded, deductible).alias("deductible"), error.alias("error"))


def grade(decision: Column, payable: Column, exclusions: Column, expected_decision: Column, expected_payable: Column, any_of: Column) -> Column:
    """``struct(pass, why)``: right decision, payable within 1, and one exclusion of every group cited."""
    cited = F.transform(F.coalesce(exclusions, F.array().cast("array<string>")), lambda x: F.replace(x, F.lit(NON_BREAKING_HYPHEN), F.lit("-")))
    why = F.array_compact(
        F.array(
            F.when(~decision.eqNullSafe(expected_decision), "decision"),
            F.when(F.when(expected_payable.isNull(), payable.isNotNull()).otherwise(payable.isNull() | (F.abs(payable - expected_payable) > 1)), "payable"),
            F.when(~F.forall(F.coalesce(any_of, F.array().cast("array<array<string>>")), lambda g: F.arrays_overlap(g, cited)), "exclusion"),
        )
    )
    return F.struct((F.size(why) == 0).alias("pass"), F.array_join(why, "; ").alias("why"))


def claim_echoed(summary: Column, claim: Column) -> Column:
    return F.array_contains(F.regexp_extract_all(summary, F.lit(CLAIM_IN_TEXT), F.lit(0)), claim)


def dates_in(summary: Column) -> Column:
    """All dates that a summary gives in one of four spellings; day and month are told apart month first."""
    def parsed(formats: tuple[str, ...]):
        def parse(x: Column) -> Column:
            short = F.regexp_replace(F.regexp_replace(x, r"(?i)\b([a-z]{3})[a-z]*\.?", "$1"), ",", "")
            return F.coalesce(*[F.try_to_date(F.regexp_replace(short, r"\s+", " "), f) for f in formats])

        return parse

    found = [F.transform(F.regexp_extract_all(summary, F.lit(pattern), F.lit(0)), parsed(formats)) for pattern, formats in DATES]
    return F.array_compact(F.concat(*found))


def amounts_of_excess(summary: Column) -> Column:
    """Amounts next to the words deductible or excess, before or after."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double")
    return F.transform(F.concat(*[F.regexp_extract_all(summary, F.lit(p), F.lit(1)) for p in (EXCESS_AFTER, EXCESS_BEFORE)]), number)


def exclusion_cited(summary: Column, expected: Column) -> Column:
    """True without a denial; with one, some exclusion is cited and all expected ones are."""
    cited = F.array_distinct(F.regexp_extract_all(summary, F.lit(EXCLUSION_IN_TEXT), F.lit(0)))
    expected = F.coalesce(expected, F.array().cast("array<string>"))
    return ~summary.rlike(DENIAL) | ((F.size(cited) > 0) & F.forall(expected, lambda e: F.array_contains(cited, e)))


def assertions(summary: Column, claim: Column, date_of_loss: Column, excess: Column, exclusions: Column) -> Column:
    """The names of the assertions that a summary fails, in order."""
    checks = (
        ("claim_number_echoed", claim_echoed(summary, claim)),
        ("date_of_loss_parseable", F.array_contains(dates_in(summary), date_of_loss)),
        ("excess_numeric", F.array_contains(amounts_of_excess(summary), excess.cast("double"))),
        ("exclusion_cited_on_denial", exclusion_cited(summary, exclusions)),
    )
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]))
