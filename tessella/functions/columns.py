"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def above_floor(value: Column, floor: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - floor) / floor))


def score(exact: Column, effective: Column, left: Column, right: Column, longest: Column, n: Column, left_size: Column, right_size: Column, least: int) -> Column:
    """Similarity of a pair from the sums over its regions; 0 without regions or tokens."""
    l, r, one = left / left_size, right / right_size, F.lit(1.0)
    anchor = F.least(one, 0.75 * 2 * l * r / (l + r) + 0.25 * F.sqrt(l * r))
    contiguity = F.least(one, 0.9 + 0.05 * longest / F.least(left_size, right_size) + 0.05 * above_floor(longest, least))
    fragmentation = F.least(one, 0.85 + 0.10 * F.sqrt(F.least(one, longest / effective)) + 0.05 * above_floor(effective / n, least))
    value = F.least(one, anchor * contiguity * fragmentation * F.sqrt(exact / effective))
    return F.when((n > 0) & (left_size > 0) & (right_size > 0), value).otherwise(F.lit(0.0))


def within_percent(column: str, low: str, high: str) -> Column:
    """Bounds are percentages as typed; what is blank or no number does not bound."""
    a, b = (F.expr(f"try_cast(nullif(trim('{x}'), '') as double)") / 100 for x in (low, high))
    return (a.isNull() | (F.col(column) >= a)) & (b.isNull() | (F.col(column) <= b))


def search(typed: str, *columns: str) -> Column:
    """Whether one of the columns has the text in it, in either case; a blank text finds all."""
    wanted, out = typed.strip().lower(), F.lit(not typed.strip())
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return out


def alias(column: str) -> Column:
    return F.concat(F.lit("SUB-"), F.upper(F.substring(F.sha2(column, 256), 1, 10)))


def slug(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(column, "[^a-zA-Z0-9._-]+", "-"), F.lit("-")), F.lit("")), F.lit(default))


def without_zip(column: str) -> Column:
    return F.regexp_replace(column, r"(?i)\.zip$", "")


def minus_spans(start: Column, end: Column, spans: Column) -> Column:
    """[start, end) without sorted spans (a, b): array of (byte_start, byte_end)."""
    kind = "array<struct<byte_start: bigint, byte_end: bigint>>"
    first = F.struct(start.alias("at"), F.array().cast(kind).alias("out"))

    def step(s, x):
        upto = F.least(x["a"], end)
        piece = F.when(upto > s["at"], F.array(F.struct(s["at"].alias("byte_start"), upto.alias("byte_end")))).otherwise(F.array().cast(kind))
        return F.struct(F.greatest(s["at"], F.least(x["b"], end)).alias("at"), F.concat(s["out"], piece).alias("out"))

    return F.aggregate(spans, first, step, lambda s: F.concat(s["out"], F.when(s["at"] < end, F.array(F.struct(s["at"].alias("byte_start"), end.alias("byte_end")))).otherwise(F.array().cast(kind))))


def render_spans(start: Column, end: Column, kind: Column, hidden: Column, size: Column) -> Column:
    """What is shown of a span, clamped to the text's bytes: a code span without the comments that follow code on their lines (sorted spans a, b), any other as it is; nothing of an empty one."""
    low, high = (F.greatest(F.lit(0), F.least(x, size)).cast("bigint") for x in (start, end))
    whole = F.array(F.struct(low.alias("byte_start"), high.alias("byte_end")))
    none = F.array().cast("array<struct<byte_start: bigint, byte_end: bigint>>")
    return F.when(high <= low, none).when(kind == "code", minus_spans(low, high, hidden)).otherwise(whole)


def dice(matched: Column, left: Column, right: Column) -> Column:
    """Shared tokens of both sides' tokens; 0 if there are none."""
    return F.when(left + right > 0, 2.0 * matched / (left + right)).otherwise(F.lit(0.0))


def fixed_percent(share: Column) -> Column:
    """A share as a percentage with one digit behind the point, rounded by the number's exact binary value, halves up; N/A for null. 20 * x is an odd whole number where x is a half: the error of the product
    tells on which side of it x lies."""
    x = share.cast("double") * 100
    high, low = 16.0 * x, 4.0 * x
    total = high + low
    back = total - high
    error = (high - (total - back)) + (low - back)
    tenths = F.floor(total / 2 + 0.5) - F.when((total / 2 + 0.5 == F.floor(total / 2 + 0.5)) & (error < 0), 1).otherwise(0)
    size = F.abs(tenths)
    return F.when(share.isNull(), "N/A").otherwise(F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(size / 10).cast("string"), F.lit("."), F.pmod(size, F.lit(10)).cast("string"), F.lit("%")))


#: Degrees between the hues of matches that follow each other, and the colours' saturation and lightness.
GOLDEN_ANGLE, SATURATION, LIGHTNESS = 137.508, 0.72, 0.52


def match_colour(index: Column) -> Column:
    """#rrggbb of the match with a number."""
    hue = F.floor(F.pmod(index * F.lit(GOLDEN_ANGLE), F.lit(360.0)) + 0.5)
    spread = SATURATION * min(LIGHTNESS, 1 - LIGHTNESS)

    def channel(turn: int) -> Column:
        k = F.pmod(hue / 30 + turn, F.lit(12.0))
        value = LIGHTNESS - spread * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.floor(value * 255 + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def public_anonymous(purpose: Column, uploader: Column) -> Column:
    """Whether a batch was handed in by a student without an account."""
    return (F.upper(purpose) == "STUDENT_SUBMISSION") & uploader.isNull()


def reveal_mode(identity: Column, purpose: Column, uploader: Column) -> Column:
    """How a submitter can be named: by the encrypted identity, by the display name of an anonymous batch, or not at all."""
    return F.when(F.coalesce(identity, F.lit("")) != "", "encrypted").when(identity.isNull() & public_anonymous(purpose, uploader), "display_name")


#: What users are told, by the message of the failure.
UPLOAD_MESSAGES = (
    ("failed to read zip archive:%", "We couldn't read that zip archive. Please upload a valid zip file."),
    ("archive nesting depth limit exceeded", "That archive is too deeply nested to process."),
    ("archive contained too many source files", "That archive contains too many source files to process."),
    ("archive expanded beyond the allowed extraction size", "That archive is too large to process after extraction."),
    ("unsafe archive entry path:%", "That archive contains invalid file paths and could not be processed."),
    ("bulk current archive must contain child zip files directly at the top level or inside one top-level folder", "That bulk archive must contain direct child zip files, or one top-level folder containing child zip files, with one child zip per submission."),
    ("bulk current archive may only contain direct child zip files or one top-level folder containing child zip files", "That bulk archive can only contain direct child zip files at the top level, or one top-level folder containing child zip files."),
    ("historical archive must contain child zip files directly at the top level or inside one top-level folder", "That historical archive must contain child zip files either directly at the top level or inside one top-level folder."),
    ("historical archive may only contain direct child zip files or one top-level folder containing child zip files", "That historical archive can only contain direct child zip files at the top level, or one top-level folder containing child zip files."),
    ("bulk current archive contains duplicate submission names after sanitization", "Two or more child zip files resolve to the same submission name. Please rename them and try again."),
    ("bulk current archive contains a child zip with an invalid name", "One or more child zip filenames become invalid after sanitization. Please rename those child zip files and try again."),
    ("no relevant % source files found in uploaded archive", "No supported source files were found in that archive for this assignment language."),
    ("no relevant % source files found after extraction", "No supported source files were found in that archive for this assignment language."),
)
UPLOAD_DEFAULT = "We couldn't process that upload. Please check the archive contents and try again."


def upload_message(column: str) -> Column:
    out, said = F.lit(UPLOAD_DEFAULT), F.lower(F.trim(column))
    for pattern, message in reversed(UPLOAD_MESSAGES):
        out = F.when(F.like(said, F.lit(pattern)), message).otherwise(out)
    return out
