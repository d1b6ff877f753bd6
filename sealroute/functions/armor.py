"""Reading, repairing and checking ASCII-armored key blocks held in a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.functions.checksum import crc24_line
from sealroute.functions.text import strip

# Frame lines and line width of the armor format.
BEGIN = "-----BEGIN PGP"
END = "-----END PGP"
KEY_HEADER = "-----BEGIN PGP PRIVATE KEY BLOCK-----"
KEY_FOOTER = "-----END PGP PRIVATE KEY BLOCK-----"
WIDTH = 76
# The ASCII characters base64 does not use. Listing them as ranges scans far faster
# than negating the alphabet.
NOT_BASE64 = r"[\x00-\x2a\x2c-\x2e\x3a-\x3c\x3e-\x40\x5b-\x60\x7b-\x7f]+"


def wrap(body: Column, width: int = WIDTH) -> Column:
    """Break a base64 body into lines of ``width`` characters, without a trailing break."""
    return F.regexp_replace(body, rf"(?s)(.{{{width}}})(?!\z)", "$1\n")


def decode_base64(rows: DataFrame, column: str, output: str) -> DataFrame:
    """Decode base64 that may hold foreign characters; null when it does not decode.

    Foreign ASCII characters are ignored and non-ASCII ones refused. Decoding stops at padding
    that completes a group of four, padding elsewhere is ignored, and what is left over must fill
    whole groups.
    """
    pieces, scan, data = F.col("_pieces"), F.col("_scan"), F.col("_data")
    start = F.struct(
        F.lit(0).alias("chars"), F.lit(0).alias("pads"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(seen: Column, size: Column) -> Column:
        chars = seen["chars"] + size
        pads = F.when(size > 0, 0).otherwise(seen["pads"]) + F.when(chars % 4 >= 2, 1).otherwise(0)
        return F.when(seen["done"], seen).otherwise(F.struct(
            chars.alias("chars"), pads.alias("pads"), (seen["used"] + 1).alias("used"),
            ((chars % 4 >= 2) & (chars % 4 + pads >= 4)).alias("done")))

    before_last = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    tail = F.length(F.element_at(pieces, -1))
    whole = scan["done"] | ((scan["chars"] + tail) % 4 == 0)
    used = F.when(scan["done"], scan["used"]).otherwise(F.size(pieces))
    padded = F.rpad(data, (F.ceil(F.length(data) / 4) * 4).cast("int"), F.lit("="))
    return (
        rows
        .withColumn("_clean", F.regexp_replace(column, NOT_BASE64, ""))
        .withColumn("_pieces", F.split("_clean", "="))
        .withColumn("_scan", F.aggregate(before_last, start, step))
        .withColumn("_data", F.when(
            whole & ~F.col(column).rlike(r"[^\x00-\x7f]"), F.array_join(F.slice(pieces, F.lit(1), used), "")))
        .withColumn(output, F.unbase64(padded))
        .drop("_clean", "_pieces", "_scan", "_data")
    )


def parse_armor(blocks: DataFrame, column: str) -> DataFrame:
    """Add the parts of each block as the columns named in ``PARTS``.

    The parts are plain columns, each used by the next step, rather than one struct: Catalyst
    then keeps a step it would otherwise repeat inside every expression that reads from it.
    """
    first, last, blank = F.col("_first"), F.col("_last"), F.col("_blank")
    framed = F.col("_framed")

    def is_checksum(line: Column) -> Column:
        return line.startswith("=") & (F.length(line) == 5)

    def position(prefix: str) -> Column:
        return F.array_position(F.transform("_lines", lambda line: line.startswith(prefix)), True).cast("int")

    def line_at(number: Column) -> Column:
        return F.when(number > 0, F.element_at("_lines", number))

    inside = F.filter(
        F.slice(F.col("_lines"), first + 1, F.greatest(last - first - 1, F.lit(0))),
        lambda line: ~line.startswith(BEGIN))
    after = F.slice(F.col("_inside"), blank + 1, F.size("_inside"))
    body = F.array_join(F.filter("_after", lambda line: ~is_checksum(line)), "")
    lines = (
        blocks
        .withColumn("_text", strip(F.replace(F.col(column), F.lit("\r\n"), F.lit("\n"))))
        .withColumn("_lines", F.split("_text", "\n"))
        .withColumns({"_first": position(BEGIN), "_last": position(END)})
        .withColumn("_framed", (first > 0) & (last > 0))
        .withColumns({"_inside": F.when(framed, inside), "_begin": line_at(first), "_end": line_at(last)})
        .withColumn("_blank", F.array_position("_inside", "").cast("int"))
        .withColumns({
            "_after": F.when(blank > 0, after).otherwise(F.array().cast("array<string>")),
            "_headers": F.when(blank > 0, F.slice(F.col("_inside"), F.lit(1), blank - 1)).otherwise(F.col("_inside")),
        })
        .withColumns({
            "_body": F.when(framed, body).otherwise(F.translate("_text", "\n\r ", "")),
            "_stored": F.get(F.filter("_after", is_checksum), F.lit(0)),
        })
    )
    return decode_base64(lines, "_body", "_payload").withColumn("_checksum", crc24_line(F.col("_payload")))


PARTS = ["_text", "_lines", "_first", "_last", "_framed", "_inside", "_begin", "_end", "_blank", "_after", "_headers",
         "_body", "_stored", "_payload", "_checksum"]


def normalise_armor(blocks: DataFrame, column: str, output: str = "normalised") -> DataFrame:
    """Re-wrap each block at the fixed width with a fresh checksum.

    A bare base64 text is framed as a private key, a text that is neither framed nor base64 comes
    back without line breaks and spaces, and a framed block whose body does not decode gives null.
    """
    wrapped = wrap(F.col("_body"))
    framed = F.concat(F.array_join(F.concat(
        F.array("_begin"), F.col("_headers"), F.array(F.lit(""), wrapped, F.col("_checksum"), F.col("_end"))),
        "\n"), F.lit("\n"))
    rebuilt = F.concat(
        F.lit(KEY_HEADER + "\n\n"), wrapped, F.lit("\n"), F.col("_checksum"), F.lit("\n" + KEY_FOOTER + "\n"))
    repaired = (
        F.when(F.col("_payload").isNotNull(), F.when(F.col("_framed"), framed).otherwise(rebuilt))
        .when(~F.col("_framed"), F.col("_body"))
    )
    return parse_armor(blocks, column).withColumn(output, repaired).drop(*PARTS)


def audit_armor(blocks: DataFrame, column: str) -> DataFrame:
    """One row of findings per block: frame, type, headers, body size and both checksums."""
    payload = F.col("_payload")
    kind = F.regexp_extract("_begin", "^-----BEGIN PGP (.*)-----$", 1)
    computed = F.when(payload.isNotNull(), F.col("_checksum"))
    return (
        parse_armor(blocks, column)
        .withColumns({
            "has_begin": F.col("_first") > 0,
            "has_end": F.col("_last") > 0,
            "block_type": F.nullif(kind, F.lit("")),
            "header_count": F.coalesce(F.size("_headers"), F.lit(0)),
            "no_blank_line": F.col("_framed") & (F.col("_blank") == 0),
            "body_bytes": F.octet_length(payload),
            "bad_body": payload.isNull(),
            "stored_crc": F.col("_stored"),
            "computed_crc": computed,
            "crc_matches": F.col("_stored") == computed,
        })
        .drop(*PARTS)
    )
