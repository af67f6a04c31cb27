"""Text cleaning used when records enter or leave a topic."""

from __future__ import annotations

import functools
import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


WHITE_SPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.trim(col, F.lit(WHITE_SPACE))


def clean_for_ingest(col: Column) -> Column:
    """Text safe to place in a JSON message.

    Quotes are dropped; line breaks (real or written as an escape), ``;`` and
    ``&`` become blanks; the ends are trimmed and runs of blanks collapse.
    """
    no_quotes = F.regexp_replace(col, "[\"']", "")
    blanks = F.regexp_replace(no_quotes, r"\\n|\\r|[\n\r;&]", " ")
    return F.regexp_replace(strip(blanks), " +", " ")


# The removals and replacements of the answer cleaner, in order.
ANSWER_REPLACEMENTS = (
    ('"', ""), ("'", ""), ("`", ""), ("\n", ""), ("\\n", ""), ("\t", ""), ("\\t", ""),
    ("\r", ""), ("\\r", ""), ("\\*", ""), ("\\ ", ""), ("\\\\", "\\"),
)
ANSWER_LINE_BREAKS = "[\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
ANSWER_ESCAPED = r"\\([a-z\-*1-9'{}`])"


def clean_answer(col: Column) -> Column:
    """Lower-cased model answer without quotes, tabs, breaks or escapes."""
    for old, new in ANSWER_REPLACEMENTS:
        col = F.replace(col, F.lit(old), F.lit(new))
    col = F.regexp_replace(col, r"\\([1-9])", "$1")
    col = F.regexp_replace(col, ANSWER_LINE_BREAKS, " ")
    return F.regexp_replace(F.lower(col), ANSWER_ESCAPED, "$1")


def contains_any(col: Column, terms: list[str]) -> Column:
    """True when one of the literal terms occurs in the text."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(col, F.lit(term))
    return hit


def contains_all(col: Column, terms: list[str]) -> Column:
    """True when every literal term occurs in the text."""
    hit = F.lit(True)
    for term in terms:
        hit = hit & F.contains(col, F.lit(term))
    return hit


def java_regex(pattern: str) -> str:
    """A Python pattern for the JVM engine: groups by number, ``\\Z`` as ``\\z``.

    JVM group names allow no underscore, so names become plain groups and
    references to them numbers.
    """
    numbers = re.compile(pattern).groupindex
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{numbers[m.group(1)]}", pattern)
    return re.sub(r"\(\?P<\w+>", "(", out).replace(r"\Z", r"\z")


@functools.lru_cache(10_000)
def pattern_fault(pattern: str) -> str | None:
    """Why a pattern cannot be used, else None; asked of both engines that see it."""
    try:
        java = "(?U)" + java_regex(pattern)
    except re.error as fault:
        return str(fault)
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark.sql("SELECT '' RLIKE :pattern AS hit", args={"pattern": java}).first()
    except PySparkException as fault:
        return str(fault).splitlines()[0]
    return None


def tilde_head(identifier: Column) -> Column:
    """First part of a ``~``-joined identifier: the variable."""
    return F.element_at(F.split(identifier, "~"), 1)


def tilde_uid(identifier: Column) -> Column:
    """Value of the last ``key=uid`` part of a ``~``-joined identifier."""
    return F.split_part(F.element_at(F.split(identifier, "~"), -1), F.lit("="), F.lit(2))


def encode_terms(col: Column) -> Column:
    """Search terms in the form they travel in: base64 of their UTF-8 bytes, on one line."""
    return F.translate(F.base64(F.encode(col, "UTF-8")), "\r\n", "")


def decode_terms(col: Column) -> Column:
    """Search terms from that form; null where it is none."""
    return F.decode(F.try_to_binary(col, F.lit("base64")), "UTF-8")
