"""Text expressions: call wording, price levels, markup."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from panelspark.functions.numeric import ladder

# Wording patterns.
TRIGGER = r"(?i)clos(?:e|es|ing)\s+(?:under|below|beneath)\s+\$?\s*([\d,]+(?:\.\d+)?)"
ZONE = r"(?i)pullback to \$?([\d,]+(?:\.\d+)?)\s*(?:to|-|and)\s*\$?([\d,]+(?:\.\d+)?)"
AFTER = r"(?i)after (\w+) (\d{1,2}) (?:earnings|report|results)"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
IN_MONTH = r"(?i)\bin (" + "|".join(MONTHS) + r")\b"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def plain_number(s: Column) -> Column:
    """``1,234.5`` text to a double; anything else is null."""
    bare = F.replace(s, F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.cast("double"))


def price_trigger(text) -> Column:
    """The level in "a close under $130"; null where none is named or it is zero."""
    v = plain_number(F.regexp_extract(_c(text), TRIGGER, 1))
    return F.when(v > 0, v)


def call_kind(action) -> Column:
    """What a call's wording commits to."""
    a = F.lower(F.coalesce(_c(action), F.lit("")))
    return ladder([
        (a.contains("pullback"), "buy_on_pullback"),
        (a.startswith("buy") & a.rlike(r"\b(in|after|from)\b"), "buy_later"),
        (a.startswith("buy"), "buy"), (a.contains("pass"), "pass"), (a.contains("watch"), "watch")], "other")


def trade_verb(action) -> Column:
    """Buy, sell, trim or none."""
    a = F.lower(F.trim(F.coalesce(_c(action), F.lit(""))))
    return ladder([(a.startswith("buy"), "buy"), (a.rlike("^(sell|exit|close)"), "sell"), (a.startswith("trim"), "trim")], "none")


def buy_zone(action) -> tuple[Column, Column]:
    """The two ends of "pullback to $a to $b"."""
    a = _c(action)
    return plain_number(F.regexp_extract(a, ZONE, 1)), plain_number(F.regexp_extract(a, ZONE, 2))


def standing(action, price, today: Column) -> Column:
    """Now, wait or skip, from the wording, the price and the day."""
    a, px = F.trim(F.coalesce(_c(action), F.lit(""))), _c(price)
    low, (z0, z1) = F.lower(a), buy_zone(a)
    named = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(a, IN_MONTH, 1)))
    return ladder([
        (low.startswith("buy now"), "now"),
        (z0.isNotNull() & z1.isNotNull() & F.coalesce((px >= z0) & (px <= z1), F.lit(False)), "now"),
        (z0.isNotNull() & z1.isNotNull(), "wait"),
        (a.rlike(AFTER), "wait"),
        ((named > 0) & (F.month(today) >= named), "now"), (named > 0, "wait"),
        (low.startswith("buy"), "now")], "skip")


# what HTML takes for a reference; a name may be followed by more letters, which stay
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"



@pandas_udf(ArrayType(StringType()))
def decode_references(s: pd.Series) -> pd.Series:
    """Each of an array of references alone; Arrow batches, null in and null out."""
    return s.map(lambda refs: [html.unescape(x) for x in refs], na_action="ignore")


def decode_entities(text) -> Column:
    """Every named and numeric entity. The text stays where it is: only its references are sent to Python."""
    s = _c(text)
    refs = F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(0))
    n, between = F.size(refs), F.split(s, REFERENCE, -1)
    # pieces have the even places and references the odd ones; a lambda could not take what Python returns
    laid = F.sort_array(F.concat(F.arrays_zip(F.sequence(F.lit(0), 2 * n, F.lit(2)), between), F.arrays_zip(F.sequence(F.lit(1), 2 * n - 1, F.lit(2)), decode_references(refs))))
    return F.when(n > 0, F.array_join(laid["1"], "")).otherwise(s)


def html_to_text(markup) -> Column:
    """Readable text of a page: content-free elements dropped, block tags to line breaks, the rest stripped.

    Every named and numeric entity is decoded; only the references of a text are sent to Python, in Arrow batches.
    """
    s = F.regexp_replace(_c(markup), r"(?is)<(script|style|head|ix:header)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?i)</?(p|div|br|tr|table|h[1-6]|li|ul|ol|section)\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return tidy_lines(F.coalesce(decode_entities(F.when(s.rlike("&[#A-Za-z]"), s)), s))


def tidy_lines(s: Column) -> Column:
    """Collapse blanks inside lines, trim every line, at most one empty line in a row."""
    s = F.regexp_replace(s, "[ \t ]+", " ")
    s = F.regexp_replace(s, r"(?m)^ +| +$", "")
    s = F.regexp_replace(s, r"\n{3,}", "\n\n")
    return F.regexp_replace(s, r"^\s+|\s+$", "")
