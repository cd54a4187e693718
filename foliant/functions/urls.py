"""URLs as Columns: levels, normal forms, categories and the slugs that name pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

LEVELS = 8
SLUG_MOST, SLUG_KEPT = 150, 140
HASHED = r"__[0-9a-f]{10}$"
_PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def segments(url: Column) -> Column:
    """Path segments without the slashes at the ends; an empty path has none."""
    own = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, "/"))


def level(url: Column, n: int) -> Column:
    """The n-th path segment from 1, or the empty string."""
    return F.coalesce(F.get(segments(url), F.lit(n - 1)), F.lit(""))


def normalised(url: Column) -> Column:
    """Scheme and host in lower case; no query, fragment or slash at the end."""
    own = strip(url)
    return F.concat(F.lower(F.regexp_extract(own, _PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(own, _PARTS, 2)), F.regexp_replace(F.regexp_extract(own, _PARTS, 3), "/+$", ""))


def category(url: Column, strict: bool = False) -> Column:
    """First path segment; without one null, or an error where ``strict``."""
    own = level(url, 1)
    none = F.raise_error(F.concat(F.lit("no category in "), url)) if strict else F.lit(None).cast("string")
    return F.when(own != "", own).otherwise(none)


def page_form(url: Column) -> Column:
    """The page that a link points to: no fragment, no slash at the end; host case is kept."""
    return F.regexp_replace(F.regexp_replace(url, "#(?s).*$", ""), "/+$", "")


def slug(url: Column) -> Column:
    """Name of a page's file without its ending; long ones are cut and hashed."""
    own = F.replace(F.regexp_replace(path(url), r"^/+|/+$", ""), F.lit("/"), F.lit("__"))
    own = F.when(own == "", F.lit("index")).otherwise(own)
    return F.when(F.length(own) > SLUG_MOST, F.concat(F.left(own, F.lit(SLUG_KEPT)), F.lit("__"), F.left(F.sha1(url), F.lit(10)))).otherwise(own)


def file_name(url: Column) -> Column:
    return F.concat(slug(url), F.lit(".html"))


def is_hashed(own: Column) -> Column:
    return F.regexp_replace(own, r"\.html$", "").rlike(HASHED)


def from_slug(own: Column, base: str) -> Column:
    """The URL that a slug stands for; null for a hashed slug, which can't be inverted."""
    bare = F.regexp_replace(own, r"\.html$", "")
    return F.when(is_hashed(own), F.lit(None).cast("string")).when(bare == "index", F.lit(base.rstrip("/") + "/")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.replace(bare, F.lit("__"), F.lit("/"))))


def found_urls(text: Column) -> Column:
    """Distinct URLs of a text, in order, without the punctuation and slashes at their ends."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s<>()\[\]\"']+"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda u: F.regexp_replace(F.regexp_replace(u, r"[.,;:!?)'\"]+$", ""), "/+$", "")))
