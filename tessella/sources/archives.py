"""Zip archives of submissions: layout, extraction with limits, concatenation, export.

An archive is a row of the binaryFile source. Recursion into nested archives is a plain function that runs where the row is; failures become
a row with an error, as the batch that they belong to fails as a whole.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.config import Limits

#: Suffixes of each language's source files.
SUFFIXES = {"java": (".java",), "c": (".c", ".h"), "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h")}
FILES = "batch_id string, display_name string, relative_path string, archive_path string, contents string, error string"
#: What is said of submissions that were left out.
WARNING = ("1 submission was skipped because it had no supported source files.", "{} submissions were skipped because they had no supported source files.")


class ArchiveError(ValueError):
    """Its messages are fixed values, which upload_message() tells apart."""


class NoSource(ArchiveError):
    pass


def entry_path(path: str) -> str:
    """Forward slashes, none at the ends, no empty, . or .. segment."""
    clean = path.replace("\\", "/").strip("/")
    if any(s in ("", ".", "..") for s in clean.split("/")):
        raise ArchiveError(f"unsafe archive entry path: {path}")
    return clean


def is_junk(path: str) -> bool:
    parts = path.split("/")
    return any(p.lower() == "__macosx" for p in parts) or parts[-1].lower() in (".ds_store", "thumbs.db") or parts[-1].startswith("._")


#: The order of signs before digits and letters in the root collation.
SIGNS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def path_key(path: str) -> tuple:
    """The order of the root collation, as UNICODE in SQL: letters first without accents and case; among equals plain before accented, then lower case before upper case."""
    base, accents, upper = [], [], []
    for c in unicodedata.normalize("NFD", path.replace("ß", "ss")):
        if unicodedata.combining(c) and base:
            accents[-1] += c
            continue
        kind = 0 if c.isspace() else 1 if c in SIGNS else 2 if not c.isalnum() else 3 if c.isdigit() else 4
        base.append((kind, SIGNS.find(c), c.lower()))
        accents.append("")
        upper.append(c.isupper())
    return base, accents, upper, path


def entries(data: bytes) -> list[tuple[str, bool, zipfile.ZipInfo]]:
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError) as e:
        raise ArchiveError(f"failed to read zip archive: {e}") from None
    return sorted(((entry_path(i.filename), i.is_dir(), i) for i in infos), key=lambda x: path_key(x[0]))


def read_entry(data: bytes, path: str) -> bytes:
    wanted = entry_path(path)
    for name, folder, info in entries(data):
        if name == wanted and not folder:
            return zipfile.ZipFile(io.BytesIO(data)).read(info)
    raise ArchiveError(f"archive entry not found: {path}")


def source_text(data: bytes) -> str:
    """UTF-8 with replacements, without a byte order mark and NULs, lines ended by LF."""
    text = data.decode("utf-8", "replace")
    return text.removeprefix("﻿").replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")


def is_source(language: str, path: str) -> bool:
    return path.lower().endswith(SUFFIXES[language])


def extract(language: str, data: bytes, boundary: str | None = None, limits: Limits = Limits()) -> list[tuple[str, str | None, str]]:
    """(relative path, archive path, contents) of the source files, nested archives included."""
    out: list[tuple[str, str | None, str]] = []
    spent = 0

    def visit(archive: bytes, chain: list[str], depth: int) -> None:
        nonlocal spent
        if depth > limits.max_depth:
            raise ArchiveError("archive nesting depth limit exceeded")
        opened = zipfile.ZipFile(io.BytesIO(archive)) if entries(archive) else None
        for name, folder, info in entries(archive):
            if folder or is_junk(name):
                continue
            if spent + info.file_size > limits.max_expanded_bytes:
                raise ArchiveError("archive expanded beyond the allowed extraction size")
            contents = opened.read(info)
            spent += len(contents)
            if name.lower().endswith(".zip"):
                visit(contents, [*chain, name], depth + 1)
            elif is_source(language, name):
                if len(out) >= limits.max_source_files:
                    raise ArchiveError("archive contained too many source files")
                where = [*([boundary] if boundary else []), *chain]
                out.append(("!/".join([*chain, name]), "!/".join(where) or None, source_text(contents)))

    visit(data, [], 0)
    if not out:
        raise NoSource(f"no relevant {language} source files found in uploaded archive")
    return sorted(out, key=lambda x: path_key(x[0]))


def child_archives(kind: str, listed: list[tuple[str, bool]]) -> list[str]:
    """Paths of the submissions' archives: all at the top, or all in one folder; kind: `bulk current` or `historical`."""
    files = [p for p, folder in listed if not folder and not is_junk(p)]
    must = f"{kind} archive must contain child zip files directly at the top level or inside one top-level folder"
    only = f"{kind} archive may only contain direct child zip files or one top-level folder containing child zip files"
    if not files:
        raise ArchiveError(must)
    tops, depth = {p.split("/")[0] for p in files if "/" in p}, {p.count("/") for p in files}
    if not (depth == {0} or (depth == {1} and len(tops) == 1)):
        raise ArchiveError(only if any(p.lower().endswith(".zip") for p in files) else must)
    if not all(p.lower().endswith(".zip") for p in files):
        raise ArchiveError(only if any(p.lower().endswith(".zip") for p in files) else must)
    return sorted(files, key=path_key)


def display_name(path: str) -> str:
    """A child archive's name for people; what it cannot hold becomes a dash."""
    name = unicodedata.normalize("NFKC", re.sub(r"(?i)\.zip$", "", path.rsplit("/", 1)[-1]))
    name = re.sub(r"\s+", " ", "".join(c for c in name if unicodedata.category(c) != "Cc"))
    name = re.sub(r"-+", "-", re.sub(r"[^\w .()\-]", "-", re.sub(r"[/\\]", "-", name))).strip(" .-_")
    if not name:
        raise ArchiveError("bulk current archive contains a child zip with an invalid name")
    return name


def bulk(language: str, data: bytes, limits: Limits = Limits()) -> tuple[list[tuple[str, list]], int]:
    """Submissions of a bulk archive, and how many children had no source and were skipped; any other failure fails all."""
    kept, skipped, names = [], 0, set()
    for path in child_archives("bulk current", [(p, f) for p, f, _ in entries(data)]):
        try:
            files = extract(language, read_entry(data, path), limits=limits)
        except NoSource:
            skipped += 1
            continue
        if (name := display_name(path)) in names:
            raise ArchiveError("bulk current archive contains duplicate submission names after sanitization")
        names.add(name)
        kept.append((name, files))
    if not kept:
        raise NoSource(f"no relevant {language} source files found in uploaded archive")
    return kept, skipped


def skip_warning(skipped: int) -> str | None:
    return None if not skipped else WARNING[0] if skipped == 1 else WARNING[1].format(skipped)


def historical(language: str, data: bytes, limits: Limits = Limits()) -> list[tuple[str, list]]:
    """Submissions of a historical archive, keyed by place and stem."""
    out = []
    for k, path in enumerate(child_archives("historical", [(p, f) for p, f, _ in entries(data)]), 1):
        key = f"historical-{k}-{path.rsplit('/', 1)[-1].removesuffix('.zip')}"
        out.append((key, extract(language, read_entry(data, path), key, limits)))
    return out


def extracted(spark: SparkSession, path: str, language: str, purpose: str = "single", limits: Limits = Limits()) -> DataFrame:
    """FILES of the archives under a path (binaryFile source); purpose: single, bulk or historical. A failed archive is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem = re.sub(r"(?i)\.zip$", "", name.rsplit("/", 1)[-1])
                try:
                    found = bulk(language, data, limits)[0] if purpose == "bulk" else historical(language, data, limits) if purpose == "historical" else [(stem, extract(language, data, limits=limits))]
                    rows += [(name, who, p, a, text, None) for who, files in found for p, a, text in files]
                except ArchiveError as e:
                    rows.append((name, stem, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[f.split()[0] for f in FILES.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, FILES)


def concatenated(files: DataFrame) -> DataFrame:
    """One row a submission: source and source_map. Files follow each other by path, each ended by a newline; bounded by the limits of extraction."""
    ended = files.where("error is null").withColumn("contents", F.when(F.endswith("contents", F.lit("\n")), F.col("contents")).otherwise(F.concat("contents", F.lit("\n")))).withColumn("n", F.octet_length("contents"))
    w = Window.partitionBy("batch_id", "display_name").orderBy(F.collate("relative_path", "UNICODE"))
    placed = ended.withColumn("ord", F.row_number().over(w) - 1).withColumn("end", F.sum("n").over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "relative_path", "end", "n", "contents")))
    done = placed.groupBy("batch_id", "display_name").agg(parts.alias("p"))
    return done.select("batch_id", "display_name", F.array_join(F.transform("p", lambda x: x["contents"]), "").alias("source"), F.transform("p", lambda x: F.struct(x["relative_path"].alias("file_path"), (x["end"] - x["n"]).alias("byte_start"), x["end"].alias("byte_end"))).alias("source_map"))


def zipped(files: DataFrame, key: str, path: str = "relative_path", contents: str = "contents") -> DataFrame:
    """key -> archive (binary) of its files."""

    def pack(rows: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in rows:
                z.writestr(zipfile.ZipInfo(r["p"], (1980, 1, 1, 0, 0, 0)), r["c"])
        return out.getvalue()

    parts = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(contents).alias("c"))))
    return files.groupBy(key).agg(F.udf(pack, "binary")(parts).alias("archive"))
