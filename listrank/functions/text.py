"""Text, price and label expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inclusive upper bounds of the price buckets.
PRICE_BOUNDS = (10, 20, 35, 50, 75, 100)


@dataclass(frozen=True)
class LabelRule:
    """An item has the label if one of the patterns is found; mask terms are what a model of it must not see."""

    patterns: tuple[str, ...]
    mask_terms: tuple[str, ...]


#: The label lexicon.
LABELS = {
    "fragrance_free": LabelRule((r"\bfragrance[- ]?free\b", r"\bunscented\b", r"\bno fragrance\b", r"\bwithout fragrance\b"), ("fragrance free", "fragrance-free", "unscented", "no fragrance")),
    "cruelty_free": LabelRule((r"\bcruelty[- ]?free\b", r"\bnot tested on animals\b", r"\bleaping bunny\b"), ("cruelty free", "cruelty-free", "not tested on animals", "leaping bunny")),
    "sulfate_free": LabelRule((r"\bsulfate[- ]?free\b", r"\bno sulfates\b", r"\bwithout sulfates\b", r"\bsls[- ]?free\b"), ("sulfate free", "sulfate-free", "no sulfates", "sls free", "sls-free")),
}


def normalize(text: Column) -> Column:
    """Lower case, with runs of any white space as one blank and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def has_label(text: Column, patterns: Sequence[str], least_length: int | None = None) -> Column:
    """1 if a pattern is found, else 0; null where the text is shorter than least_length, if given."""
    text = F.coalesce(text, F.lit(""))
    found = text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns)).cast("int") if patterns else F.lit(0)
    return found if least_length is None else F.when(F.length(text) >= least_length, found)


def mask_terms(text: Column, terms: Sequence[str]) -> Column:
    """The text with each term, in order and whatever its case, replaced by a blank; then blanks are collapsed."""
    text = F.coalesce(text, F.lit(""))
    for term in terms:
        text = F.regexp_replace(text, "(?iu)" + re.sub(r"([^\w ])", r"\\\1", term), " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def parse_price(text: Column) -> Column:
    """The first number of a price text without $ and commas; null for none, null, nan and the empty text. A sign is no
    part of it: prices that are numbers, not texts, are kept by numeric_price."""
    bare = F.trim(F.translate(text, "$,", ""))
    return F.when(~F.lower(bare).isin("", "none", "nan", "null"), F.nullif(F.regexp_extract(bare, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double"))


def numeric_price(value: Column) -> Column:
    """A price that is a number, written as one: itself, whatever its sign or size; null for NaN."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def price_bucket(price: Column, bounds: Sequence[float] = PRICE_BOUNDS) -> Column:
    out = F.when(price.isNull() | F.isnan(price), "price::unknown")
    for b in bounds:
        out = out.when(price <= b, f"price::<={b}")
    return out.otherwise(f"price::>{bounds[-1]}")


#: Stand for an escaped backslash and an escaped quote while a JSON text is cut; noncharacters, so no text has them.
_BACKSLASH, _QUOTE = "\uFDD0", "\uFDD1"
_SPACE = r"(?U)^\s+|\s+$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def json_kind(text: Column) -> Column:
    """ARRAY, OBJECT, STRING or another type of a JSON text; null where it is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), "^[A-Z]+", 0)


def json_words(text: Column) -> Column:
    """array<string> of the keys and scalars of a JSON text in their order, at any depth, without nulls.

    A JSON text is cut into strings and other scalars, and these are read again as one flat list, which undoes escapes.
    Escaped quotes are set aside first, so that no pattern needs to look back or to nest."""
    aside = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    tokens = F.regexp_extract_all(aside, F.lit(r'"[^"]*+"|[^\s\[\]{},:"]++'), F.lit(0))
    flat = F.concat(F.lit("["), F.array_join(F.filter(tokens, lambda t: t != "null"), ","), F.lit("]"))
    back = F.replace(F.replace(flat, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    return F.from_json(back, "array<string>")


def flatten_json(text: Column) -> Column:
    """A JSON value as words: a list's elements joined by blanks without nulls, "key value" pairs of an object, at any
    depth and in their order; a string as it is; anything that is no JSON, as it is; nothing for null."""
    kind = json_kind(text)
    nested = F.array_join(json_words(text), " ")
    return F.when(text.isNull() | (kind == "VOID"), "").when(kind.isin("ARRAY", "OBJECT"), nested).when(kind == "STRING", F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).otherwise(text)


def details_map(text: Column) -> Column:
    """map<string,string> of a JSON object, inner objects and lists as JSON; {"raw_details": text} of anything else,
    without white space at its ends; empty for null and blank text."""
    bare = _stripped(text)
    none = F.create_map().cast("map<string,string>")
    parsed = F.try_variant_get(F.try_parse_json(bare), "$", "map<string,variant>")
    pairs = F.map_from_entries(F.transform(F.map_entries(parsed), lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value"))))
    return F.when(F.coalesce(bare, F.lit("")) == "", none).when(json_kind(bare) == "OBJECT", pairs).otherwise(F.create_map(F.lit("raw_details"), bare))


def text_list(text: Column) -> Column:
    """array<string> of a JSON list without its nulls; one element of any other text; empty for null and blank text."""
    none = F.array().cast("array<string>")
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<string>")
    return F.when(F.coalesce(_stripped(text), F.lit("")) == "", none).otherwise(F.coalesce(F.array_compact(parsed), F.array(text)))


def scaled_rating(rating: Column) -> Column:
    """(rating - 1) / 4, kept within 0 and 1, as float."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rating - 1) / 4)).cast("float")
