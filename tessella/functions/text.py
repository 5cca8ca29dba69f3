"""Names and literals as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(c: Column) -> Column:
    """A name as SQL has it: bare when it is a plain lower-case one, else in double quotes."""
    return F.when(c.rlike("^[a-z_][a-z0-9_]*$"), c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def bare_name(c: Column) -> Column:
    """A table's name without its schema and quotes."""
    return F.regexp_replace(F.element_at(F.split(c, "\\."), -1), '"', "")


def numbered(c: Column, digits: int = 4) -> Column:
    return F.lpad(c.cast("string"), digits, "0")


def number_after(c: Column, word: str) -> Column:
    """The whole number that follows a word in a message; null without one."""
    found = F.regexp_extract(c, f"{word}\\s+(\\d+)", 1)
    return F.when(found != "", found.cast("long"))
