"""Lines of wiki tracklists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(line: Column) -> Column:
    """A line without comments, link marks, quotes of two or more and double blanks."""
    out = F.regexp_replace(line, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]|]*)\|\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[\|([^\]]*)\]\]", "$1")
    out = F.regexp_replace(out, r"\[\[([^\]]*)\]\]", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "'{2,}", ""), r"\s+", " "))


def position(text: Column) -> Column:
    """Seconds of a leading ``[minutes]`` or ``[minutes:seconds]``, else null."""
    minutes = F.regexp_extract(text, r"^\[(\d{1,3})(?::\d{2})?\]", 1).try_cast("int")
    seconds = F.regexp_extract(text, r"^\[\d{1,3}:(\d{2})\]", 1).try_cast("int")
    return minutes * 60 + F.coalesce(seconds, F.lit(0))


def entry(line: Column) -> Column:
    """struct(position, artist, title, label, catalogue, unknown) of a line, null for lines that are
    none: headings, tables, templates, dots. Lines such as "?" are entries without a name."""
    text = F.trim(F.regexp_replace(clean(line), r"(?i)^(?:<br\s*/?>|#+|\*+)\s*", ""))
    heading = text.rlike(r"^(?:\{\{|\{\||\|\}|\||!|==|\[\[Category:|Category:|<list|</list)")
    at = position(text)
    rest = F.trim(F.regexp_replace(text, r"^\[\d{1,3}(?::\d{2})?\]\s*", ""))
    unnamed = r"(?i)^(?:\?+|id|id\s*-\s*id|unbekannt|unknown|tba|id\?)$"
    bracket = F.regexp_extract(rest, r"\s*\[([^\[\]]{1,80})\]$", 1)
    name = F.when(bracket != "", F.trim(F.regexp_replace(rest, r"\s*\[[^\[\]]{1,80}\]$", ""))).otherwise(rest)
    cut = F.instr(bracket, " - ")
    label = F.trim(F.when(cut > 0, F.substring(bracket, F.lit(1), cut - 1)).otherwise(bracket))
    catalogue = F.when(cut > 0, F.trim(F.substring(bracket, cut + 3, F.length(bracket))))
    split = F.instr(name, " - ")
    artist = F.when(split > 0, F.trim(F.substring(name, F.lit(1), split - 1))).otherwise("")
    title = F.when(split > 0, F.trim(F.substring(name, split + 3, F.length(name)))).otherwise(name)
    open_ = rest.rlike(unnamed) | name.rlike(unnamed)
    none = (text == "") | heading | (rest == "") | rest.rlike(r"^(?:\.{2,}|…+)$") | (name == "") | (~open_ & (title == ""))
    named = lambda c: F.when(~open_ & (c != ""), c)
    return F.when(~none, F.struct(
        at.alias("position"), F.when(open_, "").otherwise(artist).alias("artist"), F.when(open_, "").otherwise(title).alias("title"),
        named(label).alias("label"), named(catalogue).alias("catalogue"), open_.alias("unknown"),
    ))


def section(page: Column) -> Column:
    """The part of a page under its first heading "Tracklist", up to the next heading or category; "" for none."""
    text = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    body = F.regexp_extract(text, r"(?ims)^==\s*tracklist\s*==[ \t]*$\n?(.*?)(?=^==\s*[^=\n].*?\s*==\s*?$|\[\[Category:|\z)", 1)
    return F.coalesce(body, F.lit(""))


def duration(page: Column) -> Column:
    """Seconds of the first table cell h:mm:ss that has a line of its own, else null."""
    part = lambda k: F.regexp_extract(page, r"(?m)^\|\s*(\d{1,2}):(\d{2}):(\d{2})\s*$", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def page_text(answer: Column) -> Column:
    """The text of a wiki page from the answer (JSON) to a request for it, in either of its forms; null
    where the page is missing or the answer is none."""
    at = F.try_variant_get(F.try_parse_json(answer), "$.parse.wikitext", "variant")
    plain = F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))
    return F.coalesce(F.try_variant_get(at, "$['*']", "string"), plain)


def found_pages(answer: Column) -> Column:
    """The titles that the answer (JSON) to a search names, in order; an empty array for anything else."""
    hits = F.try_variant_get(F.try_parse_json(answer), "$.query.search", "array<variant>")
    titles = F.filter(F.transform(hits, lambda h: F.try_variant_get(h, "$.title", "string")), lambda t: t.isNotNull())
    return F.coalesce(titles, F.array().cast("array<string>"))
