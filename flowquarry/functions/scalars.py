"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def q(name: str) -> Column:
    """A column by its exact name, whatever signs it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def is_finite(c: Column) -> Column:
    """True for a number that is no NaN and not infinite; never null."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF)), F.lit(False))


def finite_or_null(c: Column) -> Column:
    """Null for all that isn't finite: what imputation and statistics read."""
    return F.when(is_finite(c), c)


def canonical(c: Column) -> Column:
    """One value for all that is missing (null and NaN) and one zero, for comparing and hashing; infinities stay."""
    return F.when(c.isNull() | F.isnan(c), F.lit(float("nan"))).otherwise(c.cast("double") + F.lit(0.0))


def row_key(*cols: Column) -> list[Column]:
    """128 bits that stand for a row, as two columns: two hashes in different orders."""
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *reversed(cols))]


def signed_log10(c: Column) -> Column:
    return F.signum(c) * F.log10(F.lit(1.0) + F.abs(c))


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def at_least(c: Column, threshold: Column | float) -> Column:
    """c >= threshold; false for null and NaN (which Spark orders above every number)."""
    return F.coalesce(~F.isnan(c) & (c >= threshold), F.lit(False))


def normalized_label(c: Column) -> Column:
    """Trimmed; a dash-like sign (– — U+FFFD U+0096) with the space around it becomes ' - '; white space is collapsed."""
    t = F.regexp_replace(c, "[\\s ]*[–—�\u0096][\\s ]*", " - ")
    return F.trim(F.regexp_replace(t, "[\\s ]+", " "))


# The labels of the flow records and their families.
FAMILIES = {
    "BENIGN": "BENIGN",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DDoS": "DDoS",
    "PortScan": "PortScan",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Web Attack - Brute Force": "Web Attack",
    "Web Attack - XSS": "Web Attack",
    "Web Attack - Sql Injection": "Web Attack",
    "Bot": "Bot",
    "Infiltration": "Infiltration",
    "Heartbleed": "Heartbleed",
}


def lookup(c: Column, values: Mapping[str, str], *, what: str = "value", unknown: str = "error") -> Column:
    """The value of a small fixed mapping; an unknown or null key raises, or gives null with unknown="null"."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), c)
    if unknown == "null":
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(c, F.lit("<missing>")))))


def canonical_label(c: Column, *, unknown: str = "error") -> Column:
    """The listed spelling of a label, whatever its case, dashes and spaces."""
    return lookup(F.lower(normalized_label(c)), {k.lower(): k for k in FAMILIES}, what="label", unknown=unknown)


def family_of(c: Column, *, unknown: str = "error") -> Column:
    return lookup(c, FAMILIES, what="label", unknown=unknown)
