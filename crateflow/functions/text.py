"""Names, tags, paths and free texts, as expressions over columns.

Every function takes and returns Columns; null in gives null out unless its docstring says
otherwise. Nothing here runs Python on rows.
"""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which track a name means.
STOPWORDS = (
    "free download dl downloads original mix edit edt schranz rework remix remixes feat ft the and "
    "v1 v2 v3 v4 v5 master mastered extended radio edits reworks version intro flip bootleg tool djtool "
    "x vs with presents pres"
).split()
#: Words that make a bracket an advertisement when it holds nothing else.
BRACKET_NOISE = "final exclu exclusive premiere release preview snippet out now".split()
#: Letters that stand for other letters than their accents suggest.
LETTERS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe"}


@functools.cache
def _accents() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(letters, what each becomes, letters that become several), by Unicode decomposition."""
    single, several = {}, []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x2000), *range(0x2070, 0x2100), *range(0x2460, 0x24FF), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        if c in LETTERS or c.lower() != c:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != c:
            single[c] = plain
        elif len(plain) > 1 and plain.isascii() and plain.isalnum():
            several.append((c, plain))
    return "".join(single), "".join(single.values()), tuple(several)


def fold(name: Column) -> Column:
    """Lower case, with letters of ``LETTERS`` spelled out and accents dropped. Names of ASCII letters,
    which most are, are done once they are lower-cased; of others each character is looked up."""
    out = F.regexp_replace(F.lower(name), "([aou])\u0308", "$1e")
    marked, plain, several = _accents()
    spelled = F.from_json(F.lit(json.dumps(LETTERS | dict(several))), "map<string, string>")
    each = F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(spelled, c), c))
    full = F.regexp_replace(F.translate(F.array_join(each, ""), marked, plain), r"\p{Mn}", "")
    return F.when(out.rlike(r"[^\x00-\x7f]"), full).otherwise(out)


def words(name: Column) -> Column:
    """The words a-z0-9 of a folded name, in order; an empty array for none."""
    plain = F.regexp_replace(F.replace(fold(name), F.lit("&"), F.lit(" and ")), "['’`]", "")
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def name_tokens(name: Column, fallback: bool = True) -> Column:
    """The different words of a name without stopwords; all of them where only those are left and ``fallback``."""
    all_words = F.array_distinct(words(name))
    kept = F.filter(all_words, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(all_words) if fallback else kept


def remixer_tokens(title: Column) -> Column:
    """Words in brackets, which tell one edit from another; brackets of ``BRACKET_NOISE`` alone do not count."""
    inner = F.regexp_extract_all(title, F.lit(r"[(\[]([^)\]]+)[)\]]"), F.lit(1))
    own = F.transform(inner, lambda s: name_tokens(s, fallback=False))
    return F.array_distinct(F.flatten(F.filter(own, lambda t: F.exists(t, lambda w: ~w.isin(BRACKET_NOISE)))))


def name_key(artist: Column, title: Column) -> Column:
    """struct(tokens, remix) of an artist, which may be missing, and a title."""
    title = F.coalesce(title, F.lit(""))
    full = F.trim(F.concat_ws(" ", F.coalesce(artist, F.lit("")), title))
    return F.struct(name_tokens(full).alias("tokens"), remixer_tokens(title).alias("remix"))


def is_match(a: Column, b: Column, common: Column | None = None) -> Column:
    """Whether two token sets are alike enough to mean one track. ``common``: their intersection, where it is known."""
    n = F.size(F.array_intersect(a, b) if common is None else common)
    large, small = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    alike = ((n / large >= 0.45) & (n >= 2)) | ((n / small >= 0.8) & (n >= 2)) | ((n >= 1) & (n / large >= 0.75))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), alike).otherwise(False)


def names_match(a: Column, b: Column, common: Column | None = None) -> Column:
    """``is_match`` of two name keys (``common``: see there), with edits kept apart from originals and from each other."""
    def has(k: Column) -> Column:
        return F.size(k["remix"]) > 0

    differ = has(a) & has(b) & ~F.arrays_overlap(a["remix"], b["remix"])
    differ |= has(a) & ~has(b) & ~F.arrays_overlap(a["remix"], b["tokens"])
    differ |= has(b) & ~has(a) & ~F.arrays_overlap(b["remix"], a["tokens"])
    return is_match(a["tokens"], b["tokens"], common) & ~differ


_FREE = r"^(?:\s*(?:\(\s*free\s*(?:download|dl)\s*\)|\[\s*free\s*(?:download|dl)\s*\]))+"


def artist_title(raw: Column) -> Column:
    """struct(artist, title): cut at the first " - ", else the first " – "; notes of a free download
    in front of the artist go. Without a separator there is no artist."""
    def cut(mark: str) -> tuple[Column, Column]:
        at = F.instr(raw, mark)
        front = F.trim(F.regexp_replace(F.trim(F.substring(raw, F.lit(1), at - 1)), "(?i)" + _FREE, ""))
        return F.when(front != "", front), F.trim(F.substring(raw, at + len(mark), F.length(raw)))

    (a, t), (b, u) = cut(" - "), cut(" – ")
    hyphen, dash = F.instr(raw, " - ") > 0, F.instr(raw, " – ") > 0
    return F.struct(F.when(hyphen, a).when(dash, b).alias("artist"), F.when(hyphen, t).when(dash, u).otherwise(F.trim(raw)).alias("title"))


def guessed_artist_title(stem: Column) -> Column:
    """struct(artist, title) of a file's name without its ending: cut at the first of `` - ``, `` – ``, `` — `` and
    ``-`` that it holds, in this order; no artist where it holds none."""
    out = F.struct(F.lit("").alias("artist"), F.trim(stem).alias("title"))
    for mark in ("-", " — ", " – ", " - "):
        at = F.instr(stem, mark)
        cut = F.struct(F.trim(F.substring(stem, F.lit(1), at - 1)).alias("artist"), F.trim(F.substring(stem, at + len(mark), F.length(stem))).alias("title"))
        out = F.when(at > 0, cut).otherwise(out)
    return F.when(stem.isNotNull(), out)


def from_file_name(path: Column) -> Column:
    """struct(artist, title) of a file's name: without folders, ending and a leading ``[id]``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return artist_title(F.regexp_replace(stem, r"^\[\d+\]\s*", ""))


def id_from_file_name(path: Column) -> Column:
    """The number in brackets that a file's name begins with, else null."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^\[(\d+)\]", 1).try_cast("long")


def id_anywhere(path: Column) -> Column:
    """The first number in brackets anywhere in a path, else null."""
    return F.regexp_extract(path, r"\[(\d+)\]", 1).try_cast("long")


def normalize_tag(raw: Column) -> Column:
    """Lower case with single blanks; null for what is empty, longer than 40 characters or holds
    other characters than a-z, 0-9, ä, ö, ü, ß, blank, hyphen and underscore."""
    tag = F.lower(raw)
    for base, letter in (("a", "ä"), ("o", "ö"), ("u", "ü")):
        tag = F.replace(tag, F.lit(base + "̈"), F.lit(letter))
    tag = F.trim(F.regexp_replace(tag, r"\s+", " "))
    return F.when(tag.rlike(r"^[a-z0-9äöüß _-]{1,40}$"), tag)


def normalize_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` steps, ``..`` taken back; an empty path is ``.``."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = plain.startswith("/")
    steps = F.filter(F.split(plain, "/"), lambda s: (s != "") & (s != "."))
    empty = F.expr("cast(array() as array<string>)")

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.array_append(done, s))
        return F.when(s == "..", back).otherwise(F.array_append(done, s))

    joined = F.array_join(F.aggregate(steps, empty, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def artist_slug(name: Column) -> Column:
    """A name as the last part of a profile's address, at most 60 characters; "" where none is left."""
    text = F.lower(F.trim(name))
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(letter), F.lit(spelled))
    slug = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(slug) <= 60, slug).otherwise("")


_TOKEN = r"(?=[A-Za-z0-9._-]*\d)[A-Za-z0-9._-]{8,}(?=[\s&]|$)"


def redact(text: Column) -> Column:
    """Access tokens of chat bots, OAuth headers, parameters and arguments as ``***``."""
    out = F.regexp_replace(text, r"bot\d{5,}:[A-Za-z0-9_-]{20,}", "bot***")
    for lead in (r"OAuth\s+", "oauth_token=", r"--auth-token[=\s]"):
        out = F.regexp_replace(out, f"(?i)({lead}){_TOKEN}", "$1***")
    return out


def html_escape(text: Column) -> Column:
    """&, < and > as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def parse_timestamp(text: Column) -> Column:
    """A timestamp from text with or without T, fractions and an hour zone; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"(?:Z|\+00:00)$", "")
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats])


def json_tags(raw: Column) -> Column:
    """The texts of a JSON list, trimmed and lower-cased, each once, in order; an empty array for
    anything that is no list."""
    values = F.try_parse_json(raw)
    each = F.coalesce(F.try_variant_get(values, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    texts = F.transform(each, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.lower(F.trim(F.try_variant_get(v, "$", "string")))))
    return F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))


def contains_words(query: str, *columns: Column) -> Column:
    """Whether every word of ``query`` stands in one of the columns, whatever its case."""
    out = F.lit(True)
    for word in query.lower().split():
        found = F.lit(False)
        for c in columns:
            found |= F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
        out &= found
    return out
