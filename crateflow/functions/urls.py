"""Web addresses: hosts, kinds of download, comparable forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts by kind of download. Gates are looked for first.
GATES = {"hypeddit.com": "hypeddit", "droploud.com": "droploud", "toneden.io": "toneden", "theartistunion.com": "artist_union"}
STORES = ("bandcamp.com", "beatport.com", "traxsource.com", "juno.co.uk")
CLOUDS = ("drive.google.com", "dropbox.com")
TRANSFERS = ("wetransfer.com", "we.tl")
MEGA = ("mega.nz", "mega.co.nz", "mega.io")


def host(url: Column) -> Column:
    """The lower-case host without ``www.``; "" where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def host_matches(own: Column, *needles: str) -> Column:
    """Whether a host is one of ``needles`` or below one."""
    return reduce(lambda a, b: a | b, [(own == n) | own.endswith("." + n) for n in needles])


def classify_url(url: Column) -> Column:
    """Kind of one address: a gate, wetransfer, mega, store, cloud or none, in this order."""
    own, kind = host(url), F.when(F.lit(False), F.lit(""))
    for needle, name in GATES.items():
        kind = kind.when(host_matches(own, needle), name)
    return kind.when(host_matches(own, *TRANSFERS), "wetransfer").when(host_matches(own, *MEGA), "mega").when(host_matches(own, *STORES), "store").when(host_matches(own, *CLOUDS), "cloud").otherwise("none")


def find_urls(text: Column) -> Column:
    """All http addresses in a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))


def classify_download(url: Column, downloadable: Column, left: Column, purchase_url: Column, description: Column) -> Column:
    """struct(kind, link) of the way to get a track: native; else the first gate among the purchase
    address and those of the description; else the first of cloud, store, wetransfer, mega."""
    given = F.filter(F.concat(F.array(purchase_url), find_urls(description)), lambda u: u.isNotNull() & (u != ""))
    kinds = F.transform(given, lambda u: F.struct(classify_url(u).alias("kind"), u.alias("link")))
    gate = F.try_element_at(F.filter(kinds, lambda k: k["kind"].isin(*GATES.values())), F.lit(1))

    def first(name: str) -> Column:
        return F.try_element_at(F.filter(kinds, lambda k: k["kind"] == name), F.lit(1))

    native = F.struct(F.lit("native").alias("kind"), url.alias("link"))
    none = F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("link"))
    return F.when(F.coalesce(downloadable & left, F.lit(False)), native).otherwise(F.coalesce(gate, *map(first, ("cloud", "store", "wetransfer", "mega")), none))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def account_slug(url: Column) -> Column:
    """The last part of a profile's path, or a bare name, in lower case; "" for none."""
    text = F.trim(F.coalesce(url, F.lit("")))
    path = F.when(F.contains(text, F.lit("/")), _path(text)).otherwise(text)
    return F.lower(F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1)), F.lit("")))


def permalink_slug(url: Column) -> Column:
    """The first part of a profile's path, or a bare name, in lower case; "" for none."""
    text = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    whole = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    path = F.when(F.contains(text, F.lit("/")), _path(whole)).otherwise(F.regexp_extract(text, "^([^?#]*)", 1))
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1)), F.lit(""))


def normalize_url(url: Column) -> Column:
    """A comparable form: https, host without ``www.`` or ``m.``, lower-case path without a slash at
    its end, no query; "" for null and blank."""
    text = F.trim(F.coalesce(url, F.lit("")))
    own = F.regexp_replace(F.regexp_extract(F.lower(text), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^(?:www\.|m\.)", "")
    path = F.regexp_replace(F.lower(_path(text)), "/+$", "")
    rooted = F.when((path == "") | path.startswith("/") | (own == ""), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(text == "", "").otherwise(F.concat(F.lit("https://"), own, rooted))


def direct_url(link: Column) -> Column:
    """The address that gives a cloud file itself, or null: dropbox with ``dl=1``, drive files by id."""
    text = F.trim(link)
    whole = F.regexp_extract(text, r"(?i)^https?://((?:[a-z0-9-]+\.)*dropbox\.com(?::\d+)?)(?:[/?#]|$)", 1)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    fixed = F.transform(pairs, lambda p: F.when((p == "dl") | p.startswith("dl="), "dl=1").otherwise(p))
    with_dl = F.array_join(F.when(F.array_contains(fixed, "dl=1"), fixed).otherwise(F.array_append(fixed, F.lit("dl=1"))), "&")
    dropbox = F.concat(F.lit("https://"), whole, _path(text), F.lit("?"), with_dl)
    file = F.regexp_extract(text, r"(?i)^https?://drive\.google\.com(?-i)/file/d/([A-Za-z0-9_-]{10,})(?:/[^?#]*)?(?:[?#]|$)", 1)
    asked = F.regexp_extract(text, r"(?i)^https?://drive\.google\.com(?-i)/(?:open|uc)\?(?:[^#]*&)?id=([A-Za-z0-9_-]{10,})(?:[&#]|$)", 1)
    own = F.when(file != "", file).when(asked != "", asked)
    drive = F.concat(F.lit("https://drive.usercontent.google.com/download?id="), own, F.lit("&export=download&confirm=t"))
    return F.when(whole != "", dropbox).otherwise(drive)
