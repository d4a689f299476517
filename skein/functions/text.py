"""Text normalisation as Column builders: all codegen'd, no Python workers."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges that normalisation removes.
CONTROL_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
DECORATIVE_CLASS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2500}-\x{25FF}]+"


def _fold_table() -> tuple[str, str]:
    """Every precomposed Latin letter whose decomposition is one ASCII letter with marks; and d with stroke."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def ascii_fold(c: Column) -> Column:
    """Lower-case text without diacritics, for matching; precomposed and decomposed spellings agree."""
    return F.lower(F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}+", ""))


def fold(c: Column) -> Column:
    """ascii_fold with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(ascii_fold(c), r"\s+", " "))


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition in Arrow batches; the one text step that no built-in covers."""
    return F.pandas_udf(_compose, "string")(c)


def normalize_text(c: Column, compose: bool = False) -> Column:
    """Display copy: no control or decorative characters, white space collapsed, blank-line runs cut to one.

    compose: apply NFC first, for sources that store decomposed text.
    """
    t = nfc(c) if compose else c
    t = F.regexp_replace(F.regexp_replace(t, DECORATIVE_CLASS, ""), CONTROL_CLASS, "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def clean_str(c: Column) -> Column:
    """Single-line field: normalised, white space collapsed, empty as null."""
    return F.nullif(F.trim(F.regexp_replace(normalize_text(c), r"\s+", " ")), F.lit(""))


def clean_unknown(c: Column) -> Column:
    """Empty string for null and for spelled-out nulls."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null"), "").otherwise(t)


def to_bool(c: Column) -> Column:
    """True for true, t, 1, yes and có, whatever the case; else false."""
    return F.coalesce(F.lower(F.trim(c)).isin("true", "t", "1", "yes", "có"), F.lit(False))


def bool_text(c: Column) -> Column:
    """The text encoding of booleans: True or False."""
    return F.when(to_bool(c), "True").otherwise("False")


#: Words that only say what kind of unit a place is.
PLACE_WORDS = ("thanh pho", "thi xa", "thi tran", "quan", "huyen", "phuong", "xa", "tp", "tx")


def normalize_place(c: Column) -> Column:
    """Folded place name without unit words and punctuation."""
    t = F.regexp_replace(fold(c), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(" + "|".join(PLACE_WORDS) + r")\b", " "), r" +", " "))


def place_key(c: Column) -> Column:
    """Folded place name without any space or unit prefix, for labels that were run together."""
    return F.regexp_replace(F.regexp_replace(ascii_fold(c), r"[^a-z0-9]", ""), r"quan|huyen|thixa", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# HTML's predefined and common named entities.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape_html(c: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), c)


def clean_html_text(c: Column) -> Column:
    """Entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(unescape_html(c), r"[\s\x{A0}]+", " "))


def post_text(c: Column, see_more: tuple[str, ...] = ("see more", "xem thêm", "... see more")) -> Column:
    """Post body: line ends unified, trailing blanks and a trailing 'see more' dropped."""
    t = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+(?=\n|$)", "")
    tail = "|".join(s.replace(".", r"\.") for s in sorted(see_more, key=len, reverse=True))
    return F.trim(F.regexp_replace(t, rf"(?i)\s*(?:…|\.\.\.)?\s*(?:{tail})\s*$", ""))


def redact_phones(c: Column, mask: str = "[phone]") -> Column:
    """Mask phone-like digit runs that stand alone."""
    return F.regexp_replace(c, r"(?<!\d)(?:\+?84|0)(?:[ .\-]?\d){8,10}(?!\d)", mask)


def digit_free(c: Column, limit: int = 600) -> Column:
    """Folded first characters with every digit blanked, so that no price can be read back."""
    return F.regexp_replace(ascii_fold(F.substring(c, 1, limit)), r"\d", " ")


# Factors of count suffixes, longest first.
COUNT_SUFFIXES = (("tr", 1_000_000), ("ty", 1_000_000_000), ("k", 1_000), ("n", 1_000), ("m", 1_000_000), ("b", 1_000_000_000), ("t", 1_000_000_000))


def parse_count(c: Column) -> Column:
    """'1.2K' 1200, '1,234' 1234, '1,2K' 1200, '12 comments' 12; null if there is no number."""
    t = F.lower(F.trim(c))
    number = F.regexp_extract(t, r"^\D*?([0-9][0-9.,]*)", 1)
    suffix = F.regexp_extract(t, r"^\D*?[0-9][0-9.,]*\s*(tr|ty|[knmbt])(?![\p{L}])", 1)
    factor = reduce(lambda acc, s: acc.when(suffix == s[0], F.lit(s[1])), COUNT_SUFFIXES, F.when(F.lit(False), F.lit(1)))
    decimal = F.regexp_replace(F.replace(number, F.lit(","), F.lit(".")), r"\.+$", "").try_cast("double")
    plain = F.regexp_replace(number, r"[.,]", "").try_cast("long")
    return F.when(number == "", None).when(suffix != "", F.round(decimal * factor).cast("long")).otherwise(plain)


def normalize_url(c: Column) -> Column:
    """https, lower-case host without www or m, no query, fragment or trailing slash; null if it is no URL."""
    rest = F.regexp_extract(F.trim(c), r"^(?i:https?)://([^?#]+)", 1)
    host = F.regexp_replace(F.lower(F.split_part(rest, F.lit("/"), F.lit(1))), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/]*", ""), r"/+$", "")
    return F.when(rest != "", F.concat(F.lit("https://"), host, path))


def extract_post_id(c: Column) -> Column:
    """The post number of the URL shapes that social sites use, in order of trust."""
    patterns = (r"/posts/(\d+)", r"/permalink/(\d+)", r"[?&]story_fbid=(\d+)", r"[?&]fbid=(\d+)", r"/videos/(\d+)", r"/photos/[^/]+/(\d+)", r"[?&]multi_permalinks=(\d+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def keyword_flag(text: Column, words: list[str]) -> Column:
    """Any of the words occurs."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first rule whose pattern is found."""
    (pattern, label), *rest = rules
    out = F.when(F.regexp_like(text, F.lit(pattern)), F.lit(label))
    for pattern, label in rest:
        out = out.when(F.regexp_like(text, F.lit(pattern)), F.lit(label))
    return out.otherwise(F.lit(default))
