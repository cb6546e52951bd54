"""Standard input, files and directories as documents, without what is generated, sensitive, binary, too large or ignored.

``scan`` reads a tree of files as rows, one for each file, in parallel: the form for corpora. ``read_source`` gives one
document of one input, as the command line does: of a directory, at most 4 MiB of text, which bounds what the driver holds.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.errors import InputNotFound, MissingInput, OutputExists, ReadInput, WriteOutput
from corpusmill.functions import patterns as P
from corpusmill.functions import text as X
from corpusmill.sources.ignore import IgnoreRules

SOURCE = "source string, text string, source_warnings array<struct<code:string,message:string,severity:string>>"


def parts(path: Column) -> Column:
    return F.split(X.ascii_lower(path), "/")


def is_generated(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, P.GENERATED_PARTS)))


def is_sensitive(path: Column) -> Column:
    name = F.element_at(parts(path), -1)
    some = [F.arrays_overlap(parts(path), F.array(*map(F.lit, P.SENSITIVE_PARTS))), name.isin(*P.SENSITIVE_NAMES)]
    some += [F.startswith(name, F.lit(s)) for s in P.SENSITIVE_STARTS] + [F.endswith(name, F.lit(s)) for s in P.SENSITIVE_ENDS]
    return reduce(lambda a, b: a | b, some)


def is_binary(content: Column) -> Column:
    """A NUL within the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "\0") > 0


def low(path: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)


def skipped_as(path: str) -> str | None:
    """``generated``, ``sensitive`` or None; what is both is generated."""
    names = low(path).split("/")
    if any(n in P.GENERATED_PARTS for n in names):
        return "generated"
    return "sensitive" if names_secrets(names) else None


def names_secrets(names: list[str]) -> bool:
    """Whether a path, by its lower-cased parts, may hold credentials."""
    last = names[-1]
    return any(n in P.SENSITIVE_PARTS for n in names) or last in P.SENSITIVE_NAMES or last.startswith(P.SENSITIVE_STARTS) or last.endswith(P.SENSITIVE_ENDS)


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; both may name the scheme or not."""
    plain = F.regexp_replace(path, "^[a-z0-9+.-]+:/+", "/")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.length(plain))


def without_scheme(root: str) -> str:
    scheme, colon, rest = root.partition(":/")
    return "/" + rest.lstrip("/") if colon and "/" not in scheme else os.path.abspath(root)


def scan(spark: SparkSession, root: str, include_sensitive: bool = False) -> DataFrame:
    """Files under ``root``: rel_path, length, content, and the code of the warning for those left out (null: readable).

    Names and lengths decide first, without any content; only what is left is read. Files of folders that Spark's readers
    take for hidden (names that begin with a dot or an underscore) are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = relative(F.col("path"), without_scheme(root)).alias("rel_path")
    listed = files.select(rel, "length").filter(~is_generated(F.col("rel_path")))
    early = F.when(F.lit(not include_sensitive) & is_sensitive(F.col("rel_path")), "sensitive_path_skipped").when(F.col("length") > P.MAX_FILE_BYTES, "oversized_file_skipped")
    out = listed.select("rel_path", "length", F.lit(None).cast("binary").alias("content"), early.alias("code")).filter("code IS NOT NULL")
    fit = files.filter(F.col("length") <= P.MAX_FILE_BYTES).select(rel, "length", "content").filter(~is_generated(F.col("rel_path")) & (F.lit(include_sensitive) | ~is_sensitive(F.col("rel_path"))))
    late = F.when(is_binary(F.col("content")), "binary_file_skipped").when(~F.is_valid_utf8(F.col("content").cast("string")), "non_utf8_file_skipped")
    return fit.withColumn("code", late).unionByName(out)


def note(code: str, message: str) -> tuple[str, str, str]:
    return code, message, "warning"


def read_stdin(stream=None) -> tuple[str, str, list]:
    raw = (stream or sys.stdin.buffer).read(P.MAX_DIRECTORY_BYTES + 1)
    if len(raw) > P.MAX_DIRECTORY_BYTES:
        raise ReadInput(f"stdin input exceeds {P.MAX_DIRECTORY_BYTES} bytes")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        raise ReadInput("stdin input is not valid UTF-8") from None
    if not text.strip():
        raise MissingInput
    return "stdin", text, []


def refuse_sensitive(path: Path, include_sensitive: bool) -> None:
    if not include_sensitive and names_secrets(low(path.as_posix()).split("/")):
        raise ReadInput(f"sensitive input requires --include-sensitive: {path}")


def read_file(path: Path, include_sensitive: bool = False) -> tuple[str, str, list]:
    refuse_sensitive(path, include_sensitive)
    try:
        if path.stat().st_size > P.MAX_FILE_BYTES:
            raise ReadInput(f"{path} exceeds {P.MAX_FILE_BYTES} bytes")
        raw = path.read_bytes()
    except OSError as e:
        raise ReadInput(f"{path}: {e.strerror}") from e
    if b"\0" in raw[:1024]:
        raise ReadInput(f"{path} appears to be a binary file")
    try:
        return str(path), raw.decode(), []
    except UnicodeDecodeError:
        raise ReadInput(f"{path} is not valid UTF-8") from None


def ignore_rules(root: Path, kinds: tuple[str, ...] = P.IGNORE_FILES) -> IgnoreRules:
    """The rules of the ignore files in the root, in folders below it that are not ignored, and in those above it."""
    found: list[tuple[str, str, str]] = []

    def take(folder: Path, name_of: str) -> None:
        for kind in kinds:
            try:
                found.append((name_of, kind, (folder / kind).read_text(errors="replace")))
            except OSError:
                continue
        if name_of in ("", *up) and (folder / ".git" / "info" / "exclude").is_file():
            found.append((name_of, "exclude", (folder / ".git" / "info" / "exclude").read_text(errors="replace")))

    resolved = root.resolve()
    above = resolved.parents
    up = ["/".join([".."] * (k + 1)) for k in range(len(above))]
    for folder, name_of in zip(above, up, strict=True):
        take(folder, name_of)
    for folder, below, _ in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        below[:] = [d for d in below if d != ".git"]
        take(Path(folder), "" if rel == "." else rel)
    return IgnoreRules(found, (*kinds, "exclude"), resolved.parts[1:])


def walk(root: Path, rules: IgnoreRules) -> Iterator[tuple[str, Path]]:
    """Relative names and paths of the files below ``root`` that no rule ignores; ignored folders are not entered."""
    for folder, below, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if rel == "." else rel + "/"
        below[:] = [d for d in below if not rules.ignored(at + d, True)]
        for name in names:
            if not rules.ignored(at + name) and (path := Path(folder, name)).is_file():
                yield at + name, path


def read_directory(root: Path, include_sensitive: bool = False, kinds: tuple[str, ...] = P.IGNORE_FILES) -> tuple[str, str, list]:
    """One document of all readable files under ``root`` in path order, each under a header, up to the directory limit.

    A file that would pass the limit is left out and later, smaller ones may still fit; once the limit is reached the rest
    is left out with one warning.
    """
    refuse_sensitive(root, include_sensitive)
    if low(root.name) in P.GENERATED_PARTS:
        raise ReadInput(f"generated input is skipped by default: {root}")
    files, notes = [], []
    for rel, path in walk(root, ignore_rules(root, kinds)):
        why = skipped_as(rel)
        if why == "sensitive" and not include_sensitive:
            notes.append(note("sensitive_path_skipped", f"skipped sensitive path; pass --include-sensitive to include: {rel}"))
        elif why != "generated":
            files.append((rel.split("/"), rel, path))
    texts, total = [], 0
    for _, rel, path in sorted(files):
        try:
            size = path.stat().st_size
        except OSError as e:
            notes.append(note("file_read_failed", f"failed to stat {rel}: {e.strerror}"))
            continue
        if size > P.MAX_FILE_BYTES:
            notes.append(note("oversized_file_skipped", f"skipped file over {P.MAX_FILE_BYTES} bytes: {rel}"))
            continue
        if total >= P.MAX_DIRECTORY_BYTES:
            notes.append(note("directory_byte_limit_reached", f"skipped remaining files after {P.MAX_DIRECTORY_BYTES} aggregate bytes"))
            break
        header = f"\n\n## File: {rel}\n\n"
        if total + len(header.encode()) + size > P.MAX_DIRECTORY_BYTES:
            notes.append(note("directory_byte_limit_reached", f"skipped file after {P.MAX_DIRECTORY_BYTES} aggregate bytes: {rel}"))
            continue
        try:
            raw = path.read_bytes()
        except OSError as e:
            notes.append(note("file_read_failed", f"failed to read {rel}: {e.strerror}"))
            continue
        if b"\0" in raw[:1024]:
            notes.append(note("binary_file_skipped", f"skipped binary file: {rel}"))
            continue
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            notes.append(note("non_utf8_file_skipped", f"skipped non-utf8 file: {rel}"))
            continue
        texts.append(header + text)
        total += len(header.encode()) + len(raw)
    content = "".join(texts)
    if not content.strip():
        raise ReadInput(f"no readable text files found in {root}")
    return str(root), content, notes


def read_input(path: str | os.PathLike | None, include_sensitive: bool = False) -> tuple[str, str, list]:
    """Name, text and warnings of standard input (``-``, or nothing where content is piped), a file or a directory."""
    if path is None:
        if sys.stdin.isatty():
            raise MissingInput
        return read_stdin()
    if str(path) == "-":
        return read_stdin()
    own = Path(path)
    if own.is_file():
        return read_file(own, include_sensitive)
    if own.is_dir():
        return read_directory(own, include_sensitive)
    raise InputNotFound(str(path))


def read_source(spark: SparkSession, path: str | os.PathLike | None = None, include_sensitive: bool = False) -> DataFrame:
    """One input as one row: source, text and source_warnings, ready for ``clean``."""
    name, text, notes = read_input(path, include_sensitive)
    return spark.createDataFrame([(name, text, notes)], SOURCE)


def write(df: DataFrame, path: str, force: bool = False) -> None:
    """Write results as Parquet; an existing path is replaced only with ``force``."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_text(text: str, path: str | os.PathLike, force: bool = False) -> None:
    """Write a rendered result; an existing file is replaced only with ``force``."""
    if Path(path).exists() and not force:
        raise OutputExists(str(path))
    try:
        Path(path).write_text(text)
    except OSError as e:
        raise WriteOutput(str(e)) from e
