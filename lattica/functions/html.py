"""HTML to text, title and metadata as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, file_stem, trimmed

#: ``&amp;`` comes last, so that what it spells isn't decoded again.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&middot;": "·", "&amp;": "&",
}


def decode_entities(text: Column, numeric: bool = True) -> Column:
    """Named entities, and numeric ones as their characters; with ``numeric=False`` these become blanks."""
    if numeric:
        parts = F.regexp_extract_all(text, F.lit(r"&#[0-9]{1,7};"), 0)

        def one(acc: Column, entity: Column) -> Column:
            point = F.regexp_extract(entity, "([0-9]+)", 1).cast("int")
            utf32 = F.unhex(F.lpad(F.hex(point), 8, "0"))
            valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
            return F.replace(acc, entity, F.when(valid, F.decode(utf32, "UTF-32")).otherwise(F.lit(" ")))

        text = F.when(F.size(parts) > 0, F.aggregate(F.array_distinct(parts), text, one)).otherwise(text)
    else:
        text = F.regexp_replace(text, "&#[0-9]+;", " ")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def html_text(html: Column, multiline: bool = True, numeric: bool = True) -> Column:
    """Visible text: no scripts, styles, comments or tags; entities are decoded before tags go.

    ``multiline=False`` leaves scripts, styles and comments of several lines in, as line-wise patterns would.
    """
    flags = "(?is)" if multiline else "(?i)"
    out = F.regexp_replace(html, rf"{flags}<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, rf"{flags}<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, rf"{flags}<!--.*?-->", "")
    return clean_text(F.regexp_replace(decode_entities(out, numeric), "<[^>]+>", " "))


def html_title(html: Column, name: Column | None = None) -> Column:
    """``<title>``; else the first ``<h1>`` without tags; else the file's stem."""
    title = decode_entities(trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    heading = decode_entities(trimmed(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")))
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(title), some(heading), *([file_stem(name)] if name is not None else [F.lit("")]))


def html_counts(html: Column) -> dict[str, Column]:
    forms = {"link_count": r"(?i)<a\s+[^>]*href", "image_count": r"(?i)<img\s+[^>]*src", "heading_count": r"(?i)<h[1-6][^>]*>"}
    return {k: F.regexp_count(html, F.lit(v)) for k, v in forms.items()}


def html_lang(html: Column) -> Column:
    """Language that the root element declares; null without one."""
    found = F.regexp_extract(html, r"(?i)<html[^>]+lang=[\"']([^\"']+)[\"']", 1)
    return F.when(found != "", found)


def html_charset(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found)


def html_meta(html: Column) -> Column:
    """Map of ``meta_<name or property>`` to content; of several the last counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<meta[^>]+>)"), 1)
    pairs = F.transform(
        tags,
        lambda t: F.struct(F.lower(F.regexp_extract(t, r"(?i)(?:name|property)=[\"']([^\"']*)[\"']", 1)).alias("key"), decode_entities(F.regexp_extract(t, r"(?i)content=[\"']([^\"']*)[\"']", 1)).alias("value")),
    )
    good = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.concat(F.lit("meta_"), p["key"]), p["value"])))


def main_content(html: Column) -> Column:
    """Text of the first ``<article>``, else ``<main>``, else of the whole page."""
    some = lambda c: F.when(c != "", c)
    return html_text(F.coalesce(*[some(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)) for tag in ("article", "main")], html))
