"""What two captions have in common whatever their writing: their letters and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def caption_key(text: Column) -> Column:
    """Letters and digits (Unicode L and N), lower-cased and joined; null stays null, "" means nothing to compare."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def caption_set(entries: Column) -> Column:
    """The distinct non-empty caption keys of an array of captions, sorted; an empty array for a null one."""
    keys = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<string>")), caption_key), lambda k: k.isNotNull() & (k != ""))
    return F.array_sort(F.array_distinct(keys))


def digest(text: Column) -> Column:
    """128 bits of a text; equal digests are taken as equal texts."""
    return F.unhex(F.md5(text))
