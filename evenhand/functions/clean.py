"""Cleaning of text-coded columns, as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that mean missing, by column; others have NA only (fixed values).
SENTINELS = {
    "loan_to_value_ratio": ["NA", "Exempt"],
    "property_value": ["NA", "Exempt"],
    "debt_to_income_ratio": ["NA", "Exempt"],
    "applicant_age": ["NA", "8888"],
}
#: What the coercing parser takes as missing, and the category cleaner (fixed values).
MISSING_TEXT = ["NA", "Exempt", "", "NA ", "Not applicable"]
MISSING_CODE = ["NA", "na", ""]
#: Ordered debt-to-income labels.
DTI_LABELS = ["<20%", "20%-<30%", "30%-<36%", *(str(x) for x in range(36, 50)), "50%-60%", ">60%"]


def sentinels(column: str) -> list[str]:
    return SENTINELS.get(column, ["NA"])


def replace_sentinels(column: str) -> Column:
    c = F.col(f"`{column}`")
    return F.when(~c.isin(sentinels(column)), c)


def income_dollars() -> Column:
    """Strict: text that is no number raises."""
    return replace_sentinels("income").cast("double") * 1000.0


def loan_to_value() -> Column:
    return replace_sentinels("loan_to_value_ratio").cast("double")


def debt_to_income_position() -> Column:
    """0 to 18 by label; null where missing or unmapped (``check_debt_to_income`` raises for the latter)."""
    at = F.array_position(F.array(*map(F.lit, DTI_LABELS)), replace_sentinels("debt_to_income_ratio"))
    return F.when(at > 0, at - 1).cast("int")


def check_debt_to_income(df: DataFrame) -> DataFrame:
    """``df``, or an error that lists the labels without a place."""
    text = replace_sentinels("debt_to_income_ratio")
    odd = df.where(text.isNotNull() & ~text.isin(DTI_LABELS)).select("debt_to_income_ratio").distinct().limit(20).collect()
    if odd:
        raise ValueError(f"unmapped debt-to-income values: {sorted(r[0] for r in odd)}")
    return df


def to_float(column: str) -> Column:
    """Coercing: missing and bad text are null."""
    text = F.trim(F.col(f"`{column}`"))
    return F.when(~text.isin(MISSING_TEXT), text.try_cast("double"))


#: Ranks of the labels that are no number (fixed values).
DTI_RANKS = {"<20%": 0.0, "20%-<30%": 1.0, "30%-<36%": 2.0, "50%-60%": 17.0, ">60%": 18.0}


def debt_to_income_rank() -> Column:
    """Labels are looked up first: a cast that fails costs far more, and small expressions stay compiled."""
    text = F.trim(F.col("debt_to_income_ratio"))
    ranks = F.create_map(*(F.lit(x) for pair in DTI_RANKS.items() for x in pair))
    number = F.when(~text.isin([*MISSING_TEXT, *DTI_RANKS]), text.try_cast("double"))
    return F.coalesce(F.element_at(ranks, text), F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(36.0)), F.lit(49.0)) - 33.0))


def debt_to_income_midpoint() -> Column:
    """A range's mean, half of an upper bound, a lower bound plus 5, or the number itself."""
    text = F.trim(F.col("debt_to_income_ratio"))
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("double")
    span = r"^([0-9.]+)%?-<?([0-9.]+)%$"
    return F.coalesce((part(span, 1) + part(span, 2)) / 2.0, part(r"^<([0-9.]+)%$", 1) / 2.0, part(r"^>([0-9.]+)%$", 1) + 5.0, text.try_cast("double"))


def category(column: str) -> Column:
    text = F.trim(F.col(f"`{column}`"))
    return F.when(text.isNull() | text.isin(MISSING_CODE), F.lit("missing")).otherwise(text)


def number_or_null(column: str, factor: float = 1.0) -> Column:
    """The controlled path's parser: trimmed and coerced."""
    return F.trim(F.col(f"`{column}`")).try_cast("double") * factor


def denied() -> Column:
    return (F.col("action_taken") == "3").cast("int")


def loan_to_income() -> Column:
    ratio = F.try_divide(to_float("loan_amount"), F.nullif(to_float("income") * 1000.0, F.lit(0.0)))
    return F.when(F.abs(ratio) < float("inf"), ratio)


#: Nodes of the normal density's integral over a unit range, and their weights.
NODES = tuple(zip(*(x.tolist() for x in ((np.polynomial.legendre.leggauss(32)[0] + 1) / 2, np.polynomial.legendre.leggauss(32)[1] / 2)), strict=True))


def normal_tail(z: Column) -> Column:
    """0.5 * (1 - erf(z / sqrt 2)): the density integrated from 0 to |z| at 32 Gauss-Legendre nodes; the absolute error is below 1e-12."""
    x = F.least(F.abs(z), F.lit(9.0))
    area = sum((F.exp(x * x * (-t * t / 2)) * w for t, w in NODES), F.lit(0.0))
    upper = F.greatest(0.5 - x * area * 0.3989422804014327, F.lit(0.0))
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def expected_value(mean_principal: Column | float, margin: float = 4000.0, default_rate: float = 0.02, loss_given_default: float = 0.4) -> Column:
    """Expected dollars of one approval; the three rates are the caller's assumptions."""
    return F.lit(margin) - F.lit(default_rate * loss_given_default) * (mean_principal if isinstance(mean_principal, Column) else F.lit(mean_principal))


def psi_term(a: Column, b: Column, floor: float = 1e-4) -> Column:
    a, b = F.greatest(a, F.lit(floor)), F.greatest(b, F.lit(floor))
    return (a - b) * F.log(a / b)


def better_than(value: float, baseline: float) -> float:
    """Percent better than a baseline; raises unless the baseline is above 0."""
    if not baseline > 0:
        raise ValueError("the baseline must be above 0")
    return (value - baseline) / baseline * 100


def gini(auc: Column) -> Column:
    return auc * 2.0 - 1.0


def pairs_per_100(auc: Column) -> Column:
    return F.bround(auc * 100.0, 0)
