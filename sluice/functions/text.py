"""Text keys, cells and escapes as columns.

Unicode decomposition and case folding have no native function; they run in
Arrow batches. Everything else is built in. Null keys become empty strings where the
result is a key, and stay null elsewhere.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A blank, as Python takes it: white space and the four separators below U+0020 (with the flag (?U)).
BLANK = r"[\s\x1C-\x1F]"


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def fold_key(values: pd.Series) -> pd.Series:
    """Accents dropped, lower case, anything but word characters a blank (underscores stay), blanks collapsed."""
    return values.map(lambda s: " ".join(re.sub(r"[^\w]", " ", _bare(s)).split()) if isinstance(s, str) else "")


@F.pandas_udf(T.StringType())
def fold_order(values: pd.Series) -> pd.Series:
    """As fold_key, but underscores are blanks too: the form that orders ranks."""
    return values.map(lambda s: " ".join("".join(c if c.isalnum() else " " for c in _bare(s)).split()) if isinstance(s, str) else "")


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s.casefold() if isinstance(s, str) else "")


@F.pandas_udf(T.StringType())
def slug(values: pd.Series) -> pd.Series:
    """ASCII letters and digits joined by underscores, 120 characters at most, never empty."""

    def one(s: object) -> str:
        plain = unicodedata.normalize("NFKD", s if isinstance(s, str) else "").encode("ascii", "ignore").decode()
        return re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower()[:120] or "application"

    return values.map(one)


def pair_key(title: Column, company: Column) -> Column:
    """Plain key of a pair: each lower-cased and trimmed, joined by a bar; null is empty."""
    return F.concat(F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit("|"), F.lower(F.trim(F.coalesce(company, F.lit("")))))


def title_company_key(title: Column, company: Column) -> Column:
    """Folded title and company with a NUL between; null unless both have something left."""
    a, b = fold_key(title), fold_key(company)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\0"), b))


def clean(value: Column, single_line: bool = False) -> Column:
    """No null, no NUL, no blanks at the ends; optionally one line."""
    text = F.replace(F.coalesce(value, F.lit("")), F.lit("\0"), F.lit(""))
    text = F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")
    return F.regexp_replace(text, rf"(?U){BLANK}+", " ") if single_line else text


def score_text(value: Column) -> Column:
    """A score of 0 to 10 with one decimal; empty if missing, null if out of range."""
    number = value.try_cast("double")
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", "").when(number.between(0, 10), F.format_number(number, 1))


def cell(value: Column) -> Column:
    """A Markdown table cell."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "", "—").otherwise(F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))))


def prompt_escape(value: Column) -> Column:
    """Null if any control character is in it; angle brackets and ampersands as six-character escapes."""
    text = value
    for sign, code in (("&", "\\u0026"), ("<", "\\u003C"), (">", "\\u003E")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return F.when(~value.rlike(r"[\x00-\x1F\x7F]"), text)


def strip_html(value: Column) -> Column:
    """Tags out, six basic entities decoded, blanks collapsed."""
    text = F.regexp_replace(value, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def yaml_quote(value: Column) -> Column:
    """A value as a quoted JSON string, which YAML reads too; null is the empty string."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(value.cast("string"), F.lit("")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1")


def unexpected_keys(given: Column, allowed: tuple[str, ...]) -> Column:
    """The keys of an array that are not allowed."""
    return F.array_except(given, F.array(*[F.lit(k) for k in allowed]))
