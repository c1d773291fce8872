"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key of an item; its id is unique within its type only.
ITEM = ["item_type", "item_id"]
TYPES = ("MOVIE", "SERIES", "BOOK", "GAME")


def at(value) -> Column:
    """A timestamp column, or a literal from text."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def age_seconds(ts: Column, now) -> Column:
    return (F.unix_micros(at(now)) - F.unix_micros(at(ts))) / F.lit(1e6)


def decay(ts: Column, now, half_life_seconds: float) -> Column:
    """0.5 for each half-life of age; what lies ahead of now weighs more than 1."""
    return F.pow(F.lit(0.5), age_seconds(ts, now) / F.lit(float(half_life_seconds)))


def event_weight(event_type: Column) -> Column:
    return F.when(event_type == "rating_created", 3.0).when(event_type == "status_completed", 2.0).otherwise(0.0)


def status_weight(status: Column) -> Column:
    return F.when(status == "want", 1.0).when(status == "in_progress", 1.5).when(status == "dropped", 0.5).otherwise(0.0)


EDIT_WEIGHT = 1.0


def type_order(item_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), item_type)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; a hyphenated word also counts whole."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    whole = F.filter(F.regexp_extract_all(lower, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+"), F.lit(0)), lambda w: w != "")
    return F.concat(parts, whole)


#: What a slug leaves out, and what becomes one hyphen.
NOT_IN_SLUG, SLUG_GAP = r"[^\w\s-]", r"[-\s]+"


def slugify(folded: Column) -> Column:
    """A slug of an ASCII text: lower case, only word characters, runs of blanks and hyphens as one hyphen."""
    words = F.regexp_replace(F.lower(folded), NOT_IN_SLUG, "")
    return F.regexp_replace(F.regexp_replace(words, SLUG_GAP, "-"), "^-+|-+$", "")


def titled_slug(folded: Column, year: Column, fallback: Column) -> Column:
    """title-year, or the fallback where nothing is left of the title."""
    base = slugify(folded)
    return F.when(base == "", fallback).otherwise(F.concat_ws("-", base, year.cast("string")))


def title_from_slug(slug: Column) -> Column:
    return F.regexp_replace(slug, "-[0-9]{4}$", "")


def year_from_slug(slug: Column) -> Column:
    return F.regexp_extract(slug, "-([0-9]{4})$", 1).try_cast("int")


def publish_year(text: Column) -> Column:
    """The first year from 1000 to 2099 that stands alone among digits."""
    return F.regexp_extract(text, r"(?<![0-9])(1[0-9]{3}|20[0-9]{2})(?![0-9])", 1).try_cast("int")


def key_suffix(key: Column, kind: str = "works") -> Column:
    return F.nullif(F.regexp_extract(key, f"^/{kind}/([^/]+)$", 1), F.lit(""))


def first_positive(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x > 0), F.lit(0))


def first_text(values: Column) -> Column:
    """The first text that isn't blank, trimmed."""
    return F.get(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def loose_date(text: Column) -> Column:
    """Dates as day, month or year: 2001-02-03, 2001-02, 2001, February 3, 2001 (the first of the month)."""
    year, month = F.regexp_extract(text, "^([0-9]{4})(?:-[0-9]{2})?$", 1), F.regexp_extract(text, "^[0-9]{4}-([0-9]{2})$", 1)
    by_parts = F.when(year != "", F.try_to_date(F.concat_ws("-", year, F.when(month == "", "01").otherwise(month), F.lit("01")), "yyyy-MM-dd"))
    spoken = F.regexp_replace(text, "^([A-Za-z]+) [0-9]{1,2}, ([0-9]{4})$", "1 $1 $2")
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), by_parts, F.try_to_date(spoken, "d MMMM yyyy"))


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds.try_cast("long")))


def source_text(title: Column, original: Column, genres: Column, overview: Column, prefix: str = "passage: ") -> Column:
    """What an encoder reads of an item: its parts a line each, white space squeezed."""
    other = F.when(F.lower(original) != F.lower(title), original)

    def squeeze(x: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))

    return F.concat(F.lit(prefix), F.concat_ws("\n", *(squeeze(x) for x in (title, other, genres, overview))))


def source_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: What parts a saga's name from a subtitle; numbers of a part; the word before them; articles that are left out.
SUBTITLE = r"\s*[:–—]\s+|\s+[-–—]\s+"
PART_NUMBER = "^([0-9]{1,2}|[ivxlcdm]{1,6})$"
PART_WORD = "part"
ARTICLES = "the a an el la los las".split()


def franchise_key(title: Column) -> Column:
    """The saga that a title announces, in lower case: the words before its subtitle, without a sequel's number at their
    end and an article at their beginning. Null for a title with neither subtitle nor number, or of under three letters."""
    pieces = F.split(F.trim(title), SUBTITLE, 2)
    words = F.filter(F.split(F.lower(pieces[0]), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    counted = (F.size(words) > 1) & F.try_element_at(words, F.lit(-1)).rlike(PART_NUMBER)
    named = (F.size(words) > 2) & (F.try_element_at(words, F.lit(-2)) == PART_WORD)
    left = F.slice(words, 1, F.size(words) - F.when(counted & named, 2).when(counted, 1).otherwise(0))
    bare = F.when((F.size(left) > 1) & F.get(left, F.lit(0)).isin(*ARTICLES), F.slice(left, 2, F.size(left))).otherwise(left)
    key = F.concat_ws(" ", bare)
    return F.when(((F.size(pieces) > 1) | counted) & (F.length(key) >= 3), key)
