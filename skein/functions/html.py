"""HTML and embedded JSON: tags by pattern, whole pages by the standard parser in Arrow batches."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), 1)


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts and styles, white space collapsed."""
    t = F.regexp_replace(html, r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))


def mark_bad_links(d: DataFrame, url: str, permalink: str | None, site: list[str] | None = None) -> DataFrame:
    """d with bad: the URL has not the shape of one advert, or several rows of a site share it."""
    shared = F.count("*").over(Window.partitionBy(*(site or []), url)) > 1
    shape = ~F.coalesce(F.regexp_like(F.col(url), F.lit(permalink)), F.lit(False)) if permalink else F.lit(False)
    return d.withColumn("bad", shape | shared)


def cards(d: DataFrame, html: str, marker: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per part of the page that follows a marker, with what each pattern finds in it."""
    parts = F.slice(F.split(F.col(html), marker), F.lit(2), F.greatest(F.size(F.split(F.col(html), marker)) - 1, F.lit(0)))
    each = d.select(*keys, F.posexplode(parts).alias("k", "card"))
    return each.select(*keys, (F.col("k") + 1).cast("long").alias("pos"), *[F.regexp_extract("card", p, 1).alias(name) for name, p in fields.items()])


class _Outline(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.headings: list[str] = []
        self.images: list[str] = []
        self.paragraphs = 0

    def handle_starttag(self, tag, attrs):
        if tag == "img" and (src := dict(attrs).get("src")):
            self.images.append(src)
        self.paragraphs += tag == "p"
        if tag in ("h1", "h2"):
            self.stack.append(tag)
            self.headings.append("")

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1] == tag:
            self.stack.pop()

    def handle_data(self, data):
        if self.stack:
            self.headings[-1] += data


def parse_pages(d: DataFrame, key: str, html: str) -> DataFrame:
    """key, headings, images, paragraphs by a real parser, for markup that patterns cannot follow."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, page in zip(pdf[key], pdf[html], strict=True):
                p = _Outline()
                p.feed(page or "")
                out.append((k, [" ".join(h.split()) for h in p.headings], p.images, p.paragraphs))
            yield pd.DataFrame(out, columns=[key, "headings", "images", "paragraphs"])

    return d.select(key, html).mapInPandas(run, f"{key} {dict(d.dtypes)[key]}, headings array<string>, images array<string>, paragraphs int")


def _cut(text: str | None, key: str) -> str | None:
    start = (text or "").find(f'"{key}"')
    start = text.find("[", start) if start >= 0 else -1
    if start < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None
    return text[start:end]


def balanced_array(text: Column, key: str) -> Column:
    """The JSON array that follows a key inside other text, brackets and strings balanced."""

    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _cut(x, key))

    return cut(text)


PAYLOAD = "classification string, skip_reason string, listings array<struct<price bigint, house_type string, evidence map<string, string>>>"


def validated_listings(d: DataFrame, classes: tuple[str, ...] = ("rental",)) -> DataFrame:
    """One row per extracted listing: post, price (null unless its evidence is quoted from the text), issues.

    A payload that does not parse, or of another class, gives one row that says so.
    """
    read = d.withColumn("p", F.from_json("payload", PAYLOAD))
    each = read.select("post", "text", "p", F.explode_outer("p.listings").alias("x"))
    proof = F.col("x.evidence")["price"]
    quoted = F.coalesce(F.contains(F.lower("text"), F.lower(proof)), F.lit(False))
    issues = F.array_compact(F.array(
        F.when(F.col("p.classification").isNull(), "unreadable payload"),
        F.when(~F.col("p.classification").isin(*classes), "class not accepted"),
        F.when(F.col("x.price").isNotNull() & ~quoted, "price without evidence"),
    ))
    return each.select("post", F.when(quoted, F.col("x.price")).alias("price"), issues.alias("issues"))
