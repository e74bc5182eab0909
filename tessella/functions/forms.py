"""Rules for what is typed in or shown: dates, identities, profile fields, editor positions and status texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields and the form of an encrypted identity.
PAYLOAD = "v int, studentName string, studentNumber string, assignmentKey string, studentEmail string"
IDENTITY = r"^sidenc:v1:([a-zA-Z0-9._-]+):([a-zA-Z0-9_-]+)$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def optional_field(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def email(c: Column) -> Column:
    return F.lower(trimmed(c))


def due_date(c: Column) -> Column:
    """A timestamp; null for nothing or blanks; an error for what is no date. Dates are of ISO form."""
    typed = optional_field(c)
    read = F.when(typed.rlike(r"^\d{4}"), typed.try_cast("timestamp"))
    return F.when(typed.isNull(), None).when(read.isNull(), F.raise_error(F.lit("Please provide a valid due date.")).cast("timestamp")).otherwise(read)


def encrypted_identity(c: Column) -> Column:
    """struct(key_id, ciphertext), or null if the form is not that of an encrypted identity."""
    s = trimmed(c)
    return F.when(s.rlike(IDENTITY), F.struct(F.regexp_extract(s, IDENTITY, 1).alias("key_id"), F.regexp_extract(s, IDENTITY, 2).alias("ciphertext")))


def identity_payload(c: Column) -> Column:
    """The fields of a decrypted JSON identity, trimmed, key and address in lower case; null if the version is not 1 or a required one is missing."""
    p = F.from_json(c, PAYLOAD)
    name, number, key = (optional_field(p[k]) for k in ("studentName", "studentNumber", "assignmentKey"))
    fields = F.struct(name.alias("student_name"), number.alias("student_number"), F.lower(key).alias("assignment_key"), F.lower(optional_field(p["studentEmail"])).alias("student_email"))
    return F.when((p["v"] == 1) & name.isNotNull() & number.isNotNull() & key.isNotNull(), fields)


def editor_position(text: Column, offset: Column) -> Column:
    """struct(line, column), from 1, of a byte offset; columns count code points. An offset within a character is that of its start; others are clamped to the text."""
    data = text.cast("binary")
    at = F.greatest(F.lit(0), F.least(offset.cast("int"), F.octet_length(text)))
    # the bytes before the offset; a character that they cut is the last of theirs, and does not count
    before = F.substring(data, F.lit(1), at).cast("string")
    cut = F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF").cast("int")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1 - cut).alias("column"))


def byte_offset(text: Column, line: Column, column: Column) -> Column:
    """The byte offset of a line and a column; a place that the text has not is its end."""
    lines = F.split(text, "\n")
    at = F.try_element_at(lines, F.when(line >= 1, line.cast("int")))
    above = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line.cast("int") - 1, F.lit(0))), F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    there = at.isNotNull() & (column >= 1) & (column <= F.length(at) + 1)
    return F.when(there, above + F.octet_length(F.substring(at, F.lit(1), column.cast("int") - 1))).otherwise(F.octet_length(text))


#: What users are told, by the status.
STATUS_LABELS = {"not_ready": "not ready", "ready": "ready to run"}
STATUS_TEXTS = {
    "preparing": "Uploads are still being prepared.",
    "running": "A comparison job is in progress.",
    "current": "Current results match the latest prepared inputs.",
    "stale": "Displayed results are from older inputs.",
    "failed": "The latest comparison attempt failed.",
    "ready": "Prepared inputs are ready for a manual run.",
    "not_ready": "More prepared submissions are needed before running.",
}
EMPTY_TEXTS = {
    "preparing": "Wait for uploads to finish preparing before running comparisons.",
    "running": "The worker is processing this comparison right now.",
    "failed": "No current results are available because the latest run failed.",
    "not_ready": "At least one current submission and two non-template submissions are required.",
}
EMPTY_DEFAULT = "Run a comparison to see suspicious pairs."
UPLOAD_STATES = {
    "ready": "This upload finished successfully.",
    "completed": "This upload finished successfully.",
    "failed": "This upload did not finish successfully.",
    "queued": "Waiting to be processed.",
    "processing": "Still being processed.",
    "running": "Still being processed.",
}
UPLOAD_WARNED = "This upload finished with warnings."
PURPOSES = {"historical_submission": "Historical Submissions", "template_upload": "Template Code"}
UPDATED = "Status updated."


def told(c: Column, texts: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in texts.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def status_label(status: Column) -> Column:
    return told(status, STATUS_LABELS, F.replace(status, F.lit("_"), F.lit(" ")))


def status_text(status: Column) -> Column:
    return told(status, STATUS_TEXTS, F.lit(UPDATED))


def empty_text(status: Column) -> Column:
    return told(status, EMPTY_TEXTS, F.lit(EMPTY_DEFAULT))


def upload_summary(status: Column, error: Column, warning: Column) -> Column:
    """An error is shown itself, its first 120 characters; then a warning is mentioned; then the status tells."""
    return F.when(error != "", F.substring(trimmed(error), 1, 120)).when(warning != "", UPLOAD_WARNED).otherwise(told(F.lower(status), UPLOAD_STATES, F.lit(UPDATED)))


def upload_purpose(purpose: Column) -> Column:
    """Words in place of the code, each with a capital."""
    words = F.transform(F.split(F.regexp_replace(purpose, "[_-]+", " "), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return told(purpose, PURPOSES, F.array_join(words, " "))
