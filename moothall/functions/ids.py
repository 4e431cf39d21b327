"""Deterministic identities and normalised names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles that name no particular matter.
GENERIC_TITLES = ("vta", "caltrain", "city staff", "public comment", "public letters", "staff comments", "future business", "review of minutes", "city and district reports", "open forum", "closed session", "oral communications")
#: Marks of an ordinance's stage, taken off in this order.
READING = (r"^FIRST\s+READ(?:ING)?:\s*", r"^SECOND\s+READ(?:ING)?:\s*", r"^THIRD\s+READ(?:ING)?:\s*", r"^FINAL\s+READ(?:ING)?:\s*", r"^REINTRODUCED\s+(?:FIRST\s+)?(?:SECOND\s+)?READ(?:ING)?:\s*")
SHORTEST_TITLE = 30


def collapse(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_reading(title: Column) -> Column:
    for p in READING:
        title = F.regexp_replace(title, f"(?iU){p}", "")
    return title


def matter_title(title: Column) -> Column:
    """The title as a key; null for short and generic ones."""
    flat = collapse(title)
    key = F.lower(collapse(without_reading(flat)))
    return F.when((F.length(flat) >= SHORTEST_TITLE) & ~F.lower(flat).isin(*GENERIC_TITLES) & (F.length(key) >= SHORTEST_TITLE), key)


def given(text: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(text, F.lit(""))


def digest(key: Column, length: int) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, length)


def matter_id(city: Column, file: Column, vendor_id: Column, title: Column) -> Column:
    """By file, else vendor id, else usable title; null without any of them."""
    part = lambda kind, value: F.concat(city, F.lit(f":{kind}:"), value)
    by_title = F.when(given(file).isNull() & given(vendor_id).isNull(), part("title", matter_title(title)))
    key = F.coalesce(part("file", given(file)), part("id", given(vendor_id)), by_title)
    return F.concat(city, F.lit("_"), digest(key, 16))


def meeting_id(city: Column, vendor_id: Column, date: Column, title: Column) -> Column:
    key = F.concat(city, F.lit(":"), vendor_id, F.lit(":"), F.date_format(date, "yyyyMMdd'T'HHmmss"), F.lit(":"), title)
    return F.concat(city, F.lit("_"), F.substring(F.md5(key.cast("binary")), 1, 8))


def item_id(meeting: Column, vendor_item_id: Column, sequence: Column, title: Column) -> Column:
    own = F.regexp_replace(F.lower(given(vendor_item_id)), r"\s+", "")
    made = F.concat(F.lit("seq"), F.lpad(sequence.cast("string"), 3, "0"), F.lit("_"), digest(F.concat_ws(":", meeting, title), 8))
    return F.concat(meeting, F.lit("_"), F.coalesce(own, made))


def person_id(city: Column, name: Column, mark: str = "cm") -> Column:
    """cm for members, comm for committees."""
    return F.concat(city, F.lit(f"_{mark}_"), digest(F.concat(city, F.lit(":"), F.lower(collapse(name))), 16))


def is_matter_id(text: Column) -> Column:
    return text.rlike("^[a-z0-9]+[A-Z]{2}_[0-9a-fA-F]{16}$")


def city_of(text: Column) -> Column:
    return F.when(is_matter_id(text), F.split_part(text, F.lit("_"), F.lit(1)))


def attachments_hash(attachments: Column) -> Column:
    """A digest of the set of (url, name) pairs; empty for none."""
    pairs = F.array_sort(F.transform(attachments, lambda a: F.concat_ws("|", a["url"], a["name"])))
    return F.when(F.size(attachments) > 0, F.sha2(F.array_join(pairs, "\n").cast("binary"), 256)).otherwise("")
