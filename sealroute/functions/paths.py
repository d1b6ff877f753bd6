"""File names, target names and path safety as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extension of protected files and the default prefix of outputs.
EXTENSION = ".pgp"
DEFAULT_PREFIX = "data_encrypted_"

# Substrings of the lower-cased raw value that mark it unsafe.
UNSAFE_PATTERNS = ["../", ".\\\\", "%2e%2e", "%252e", "..%2f", "..%5c"]

# Compatibility forms of dots and slashes, and what strict mode reads them as.
LOOKALIKES = "․．∕／＼﹨"
LOOKALIKE_ASCII = "..//\\\\"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def in_folder(folder: Column, name: Column) -> Column:
    return F.concat(folder, F.lit("/"), name)


def drop_trailing_slashes(folder: Column) -> Column:
    return F.rtrim(folder, F.lit("/"))


def has_extension(name: Column) -> Column:
    return F.lower(name).endswith(EXTENSION)


def is_system_file(name: Column) -> Column:
    return name.startswith("_")


def plain_name(name: Column) -> Column:
    """The file name without its four-character extension."""
    return F.substr(name, F.lit(1), F.length(name) - len(EXTENSION))


def digits_of(ts: Column, width: int) -> Column:
    """``YYYYmmddHHMMSS`` plus microseconds, cut to ``width``.

    ``ts`` is a ``timestamp_ntz`` in UTC; going through its text form keeps the session time
    zone out of it.
    """
    digits = F.regexp_replace(ts.cast("timestamp_ntz").cast("string"), "[^0-9]", "")
    return F.substring(F.rpad(digits, 20, "0"), 1, width)


def archive_name(ts: Column, name: Column) -> Column:
    return F.concat(digits_of(ts, 20), F.lit("_"), name)


def plain_output_name(prefix: Column, ts: Column) -> Column:
    return F.concat(prefix, digits_of(ts, 14), F.lit(".csv"))


def sealed_output_name(prefix: Column, ts: Column) -> Column:
    return F.concat(prefix, digits_of(ts, 14), F.lit(".csv.pgp"))


def dated_path(folder: Column, ts: Column, name: Column) -> Column:
    digits = digits_of(ts, 8)
    return F.concat_ws(
        "/", folder, F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2), name
    )


def _percent_decoded(value: Column) -> Column:
    # A stray % is kept as it is, so it is escaped first; "+" must survive as well.
    escaped = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))


def _climbs(decoded: Column) -> Column:
    segments = F.split(F.replace(decoded, F.lit("\\"), F.lit("/")), "/")
    return F.array_contains(segments, "..")


def is_safe_path(value: Column, strict: bool = False) -> Column:
    """False for a folder value that could climb out of its root.

    One decoding round by default. ``strict`` decodes three rounds and reads compatibility dots
    and slashes as ASCII.
    """
    decoded = value
    unsafe = F.lit(False)
    for _ in range(3 if strict else 1):
        decoded = _percent_decoded(decoded)
        if strict:
            decoded = F.translate(decoded, LOOKALIKES, LOOKALIKE_ASCII)
        unsafe = unsafe | _climbs(decoded)
    raw = F.lower(value)
    for pattern in UNSAFE_PATTERNS:
        unsafe = unsafe | raw.contains(F.lit(pattern))
    return ~unsafe


def first_unsafe(folders: dict[str, Column], strict: bool = False) -> Column:
    """Name of the first unsafe folder in the given order, null when all are safe."""
    return F.coalesce(
        *[F.when(~is_safe_path(value, strict), F.lit(name)) for name, value in folders.items()]
    )


def is_bad_key_path(path: Column) -> Column:
    return path.contains("..") | path.startswith("/")
