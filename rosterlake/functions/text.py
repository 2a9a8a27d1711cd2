"""Names, e-mail addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\r\n"


def tidy(text: Column) -> Column:
    """Strip blanks, tabs and line ends on both sides; NULL stays NULL."""
    return F.btrim(text, F.lit(BLANKS))


def tidy_all(df: DataFrame) -> DataFrame:
    """Strip every text column."""
    return df.select(
        *[
            tidy(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def not_blank(text: Column) -> Column:
    return text.isNotNull() & (tidy(text) != "")


def first_word(name: Column) -> Column:
    return F.substring_index(name, " ", 1)


def after_first_word(name: Column) -> Column:
    """Everything after the first space; NULL for a one-word name."""
    space = F.locate(" ", name)
    return F.when(space > 0, F.substring(name, space + 1, F.length(name)))


def full_name(first: Column, last: Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def email_for(first: Column, last: Column, entity_id: Column) -> Column:
    """Lower-case first.last.id@example.com; unique because the id is."""
    return F.lower(F.concat(first, F.lit("."), last, F.lit("."), entity_id.cast("string"), F.lit("@example.com")))


def email_variant(email: Column, suffix: Column) -> Column:
    """The same address with a running number before its last @ (or at its end), for suffix > 0."""
    host = F.regexp_extract(email, "(@[^@]*)$", 1)
    name = F.left(email, F.length(email) - F.length(host))
    numbered = F.concat(name, F.lit("."), suffix.cast("string"), host)
    return F.when(suffix > 0, numbered).otherwise(email)


def looks_like_email(email: Column) -> Column:
    return F.contains(email, F.lit("@")) & F.contains(email, F.lit("."))


def has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9]"))


def role_label(role: Column, level: Column) -> Column:
    return F.format_string("%s (Lvl %d)", role, level)


def contains_fragment(text: Column, fragment: str, *, literal: bool = False) -> Column:
    """Case-insensitive substring test.

    By default % and _ in the fragment act as wildcards; literal=True takes them as they are.
    """
    if literal:
        for mark in ("\\", "%", "_"):
            fragment = fragment.replace(mark, "\\" + mark)
    return text.ilike(f"%{fragment}%")
