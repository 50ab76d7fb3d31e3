"""Contact data: detection, redaction, and the first address that somebody reads.

A built-in test picks the few texts that can hold any; these alone go to Python, in
one pass that yields both the redacted text and whether anything was found.
"""

from __future__ import annotations

import html
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

# What a text must have to hold an address, a phone, a street with a number, or either in encoded form. Python takes U+001C to U+001F for blanks, too.
_SIGNS = (r"@", r"(?U)\d[\d\s\x1C-\x1F()./-]{5,}\d", r"%[0-9A-Fa-f]{2}|&[#A-Za-z]")
_STREETS = r"(?iU)\b(?:via|viale|piazza|corso|calle|carrer|street|st|road|rd|avenue|ave|boulevard|blvd)\b"


def contact_email(text: Column) -> Column:
    """The first e-mail address whose local part is not a no-reply one."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + fixed.EMAIL), F.lit(0))
    return F.get(F.filter(found, lambda x: ~F.lower(F.substring_index(x, "@", 1)).isin(*fixed.NO_REPLY)), 0)


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike("(?U)" + fixed.SECRET), F.lit(False))


def suspect(text: Column) -> Column:
    """Whether a text may hold contact data: a superset, by built-in matching alone."""
    any_sign = text.rlike(_SIGNS[0]) | text.rlike(_SIGNS[1]) | text.rlike(_SIGNS[2])
    return F.coalesce(any_sign | (text.rlike(_STREETS) & text.rlike(r"(?U)\d")), F.lit(False))


def decoded(text: str) -> list[str]:
    """A text, what decoding makes of it, what decoding makes of that, and so on while it is new."""
    forms = {text: None}
    if "%" in text or "&" in text:
        for _ in range(fixed.DECODE_ROUNDS):
            forms.setdefault(html.unescape(unquote(next(reversed(forms)))))
    return list(forms)


def _phone(found: re.Match) -> str:
    digits = sum(map(str.isdigit, found[0]))
    return found[0] if digits < 7 or re.fullmatch(fixed.PLAIN_DATE, found[0]) else fixed.PHONE_TOKEN


#: In this order: what one rule has replaced, the next no longer sees.
_SCRUB = (
    (re.compile(fixed.EMAIL), fixed.EMAIL_TOKEN), (re.compile(fixed.PHONE), _phone),
    *((re.compile(p), fixed.ADDRESS_TOKEN) for p in (fixed.STREET_PREFIX, fixed.STREET_SUFFIX, fixed.STREET_NUMBER)),
)


def scrubbed(text: str) -> str:
    """A text as it stands, with its contact data replaced."""
    for pattern, token in _SCRUB:
        text = pattern.sub(token, text)
    return text


def scan(text: str) -> tuple[str, bool]:
    """The most decoded form that holds contact data, redacted, and True; or the text itself and False."""
    for form in reversed(decoded(text)):
        clean = scrubbed(form)
        if clean != form:
            return clean, True
    return text, False


@F.pandas_udf(T.StructType([T.StructField("redacted", T.StringType()), T.StructField("found", T.BooleanType())]))
def _scanned(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, False) if t is None else scan(t) for t in texts], columns=["redacted", "found"])


def _scan(text: Column) -> Column:
    return _scanned(F.when(suspect(text), text))


def redact_contacts(text: Column) -> Column:
    """The text with contact data redacted; without any it is unchanged, null stays null."""
    return F.coalesce(_scan(text)["redacted"], text)


def contains_contact(text: Column) -> Column:
    """Whether any decoded form of the text holds contact data; false for null."""
    return F.coalesce(_scan(text)["found"], F.lit(False))
