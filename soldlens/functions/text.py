"""Text scalars as column expressions; a pandas UDF only where Unicode normal forms are needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Invisible marks, and Latin letters for look-alikes.
INVISIBLE = r"[​-‏⁠-⁤﻿­]"
HOMOGLYPHS = ("АВЕКМНОРСТХаеорсухіјѕԁոս", "ABEKMHOPCTXaeopcyxijsdnu")


def bind(value: Column, fn) -> Column:
    """fn(value) with value computed once, however often fn uses it: keeps expression trees small."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def clean_text(c: Column) -> Column:
    """Without invisible marks, white space collapsed; null is ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""), r"(?U)\s+", " "))


def normalize_title_ascii(c: Column) -> Column:
    """The matching form of an ASCII title, natively."""
    words = F.trim(F.regexp_replace(F.lower(clean_text(c)), r"[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"^new listing\s+", "")


def _title_form(text: str | None) -> str:
    text = re.sub("[​-‏⁠-⁤﻿­]", "", text or "")
    folded = unicodedata.normalize("NFKC", " ".join(text.split())).casefold()
    return re.sub(r"^new listing\s+", "", re.sub(r"[\W_]+", " ", folded).strip())


@F.pandas_udf(T.StringType())
def normalize_title(titles: pd.Series) -> pd.Series:
    """Case-, width- and punctuation-insensitive form of any title."""
    return titles.map(_title_form)


def normalize_keywords(c: Column) -> Column:
    """Invisible marks gone, white space collapsed, case folded (upper case and back, as one letter may have two small forms)."""
    return clean_text(F.lower(F.upper(clean_text(c))))


def synthetic_id(site: Column, title_norm: Column, price: Column, sold: Column) -> Column:
    """x- and 16 hex digits of the SHA-1 over site, title, price and date."""
    key = F.concat_ws("|", site, title_norm, F.when(price.isNotNull(), F.format_string("%.2f", price)).otherwise(""), F.coalesce(F.date_format(sold, "yyyy-MM-dd"), F.lit("")))
    return F.concat(F.lit("x-"), F.substring(F.sha1(key), 1, 16))


def is_synthetic(item_id: Column) -> Column:
    return F.coalesce(item_id.startswith("x-"), F.lit(False))


def truncates(short: Column, full: Column) -> Column:
    """Whether one normalised title is a strict beginning of the other."""
    return (F.length(short) < F.length(full)) & full.startswith(short)


def slug(c: Column, length: int = 60) -> Column:
    """Words joined by '-', cut to a length."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, length), r"-+$", "")


def fold_quotes(c: Column) -> Column:
    """Dashes and quotes to their ASCII forms, lower case."""
    return F.lower(F.translate(c, "‐‑‒–—―‘’‚“”„", "------'''\"\"\""))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *HOMOGLYPHS), r"(?U)[^\p{L}]", "")


def unescape(c: Column) -> Column:
    """The common character references as characters."""
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&rsquo;", "’"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def word_count(c: Column) -> Column:
    text = clean_text(c)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")


def money_text(v: Column) -> Column:
    return F.coalesce(F.format_number(v, 2), F.lit("-"))
