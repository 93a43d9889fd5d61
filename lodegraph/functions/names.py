"""Identifiers: naming styles, splitting into words, canonical names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry nothing in an identifier (fixed values).
STOP_WORDS = ("the", "a", "an", "of", "to", "for", "and", "or", "is", "in", "on", "at", "as", "if", "by", "be", "fn", "def", "self", "this", "that", "do", "it", "fn1")


def style(name: Column) -> Column:
    """kebab, screaming, snake, mixed, pascal or camel, tried in that order."""
    upper, lower, under, hyphen = (name.rlike(p) for p in ("[A-Z]", "[a-z]", "_", "-"))
    return (
        F.when(hyphen & ~under, "kebab").when(under & ~lower, "screaming").when(under & ~upper, "snake").when(under, "mixed")
        .when(name.rlike("^[A-Z]") & lower, "pascal").when(~name.rlike("^[A-Z]") & upper, "camel").when(~upper & (F.length(name) > 0), "snake").otherwise("mixed")
    )


def split_identifier(name: Column) -> Column:
    """The lower-case words of an identifier, and the phrase that they form if there are several."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    parts = F.filter(F.transform(F.split(spaced, r"[\s_-]+"), F.lower), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    phrase = F.array_join(parts, " ")
    return F.when((F.size(parts) > 1) & ~F.array_contains(parts, phrase), F.array_append(parts, phrase)).otherwise(parts)


def token_estimate(text: Column) -> Column:
    """Tokens of about four bytes."""
    return F.ceil(F.octet_length(text) / 4)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
