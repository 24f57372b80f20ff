"""Text clean-up, keys and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blank_to_null(value: Column) -> Column:
    """Strip spaces (not tabs); text that is empty afterwards becomes NULL."""
    return F.nullif(F.trim(value), F.lit(""))


def service_key(npi: Column, code: Column, place: Column) -> Column:
    """SHA-256 of the three grain columns; a NULL part is skipped."""
    return F.sha2(F.concat_ws("||", npi, code, place), 256)


def display_name(is_org: Column, first: Column, last: Column) -> Column:
    """Organisation name, or ``first last``; unknown entity counts as a person."""
    return F.when(is_org, last).otherwise(F.concat_ws(" ", first, last))


def hcpcs_family(code: Column) -> Column:
    return F.left(code, F.lit(1))


def clean_identifier(name: str) -> str:
    """A column name without spaces, slashes or parentheses."""
    return name.translate(str.maketrans({" ": "_", "/": "_", "(": None, ")": None}))
