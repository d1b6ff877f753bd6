"""Text clean-up shared by requests, keys, armor and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a request or key value loses at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The characters that end the first line of a message.
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85  "

# How much of a message or run id is kept, and what a stuck file's message ends in.
MESSAGE_LIMIT = 200
SETUP_MESSAGE_LIMIT = 400
RUN_ID_LIMIT = 20
STUCK_WARNING = " | WARNING: file stuck in source_folder"


def strip(value: Column) -> Column:
    """Drop white space, Unicode kinds included, at both ends (``trim`` alone drops only spaces)."""
    return F.trim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def is_blank(value: Column) -> Column:
    return blank_to_null(value).isNull()


def first_line(message: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """First line of an error text, cut to ``limit`` characters; an empty text stays empty."""
    line = F.regexp_extract(message, f"^[^{LINE_BREAKS}]*", 0)
    return F.substring(F.coalesce(line, F.lit("")), 1, limit)


def list_entry(name: Column, message: Column) -> Column:
    """``name: message``, or the bare name when there is no message."""
    return F.concat_ws(": ", name, F.nullif(message, F.lit("")))


def with_stuck_warning(message: Column, move_error: Column) -> Column:
    """A failed file that could not be quarantined says so in its message."""
    return F.when(move_error.isNotNull(), F.concat(message, F.lit(STUCK_WARNING))).otherwise(message)


def clean_run_id(run_id: Column) -> Column:
    kept = F.regexp_replace(strip(run_id), "[^A-Za-z0-9]", "")
    return F.substring(F.coalesce(kept, F.lit("")), 1, RUN_ID_LIMIT)


def unwrap_secret(material: Column) -> Column:
    """A secret is plain text, or a JSON object holding it under ``value`` or ``Value``."""
    def field(key: str) -> Column:
        return F.nullif(F.get_json_object(material, f"$.{key}"), F.lit(""))

    is_object = F.get_json_object(material, "$").startswith("{")
    wrapped = F.coalesce(field("value"), field("Value"), F.lit(""))
    return strip(F.when(is_object, wrapped).otherwise(material))
