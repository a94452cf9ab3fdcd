"""Source trees and archives as file tables."""

from __future__ import annotations

import io
import posixpath
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.dimensions import (
    MAX_ARCHIVE_FILES,
    MAX_FILE_BYTES,
    MAX_FILES,
    MAX_PROJECT_BYTES,
    PROJECT_LANGUAGES,
    PROJECT_SKIP_DIRS,
)
from vulnlake.operators.filters import in_ignored_dir, language_by_extension
from vulnlake.operators.scale import bounded_broadcast


def read_tree(spark: SparkSession, root: str, *, languages=PROJECT_LANGUAGES, skip_dirs=PROJECT_SKIP_DIRS,
              max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """Scannable files below a folder: file_id, path, language, size, text.

    Size, path and language are tested on the listing, before any content is read. A size
    limit and a file limit (first paths in order) are features of a project scan, as in
    ``project_limits``; nothing is left out unless they are given.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    clean = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.when(clean.contains(base), F.element_at(F.split(clean, base, 2), 2)).otherwise(clean)
    sized = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    kept = (sized.withColumn("_rel", relative)
            .withColumn("language", language_by_extension(F.col("_rel"), languages))
            .filter(F.col("language").isNotNull() & ~in_ignored_dir(F.col("_rel"), skip_dirs)))
    if max_files is not None:
        first = kept.select("path").orderBy("path").limit(max_files)
        kept = kept.join(bounded_broadcast(first), "path", "left_semi")
    return kept.select(F.xxhash64("path").alias("file_id"), F.col("_rel").alias("path"), "language",
                       F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))


BATCH_BYTES = 16 << 20
MEMBER_SCHEMA = "archive string, member string, size long, status string, content binary"


def project_limits() -> dict[str, int]:
    """The limits of a project scan, for `read_tree`."""
    return {"max_bytes": MAX_FILE_BYTES, "max_files": MAX_FILES}


def archive_limits() -> dict[str, int]:
    """The limits of an uploaded project, for `read_archives`."""
    return {"max_bytes": MAX_PROJECT_BYTES, "max_files": MAX_ARCHIVE_FILES}


def _members(archive: str, content: bytes, max_bytes: int | None, max_files: int | None):
    """Rows of one archive: its members, or one row that says why it is refused."""
    if max_bytes is not None and len(content) > max_bytes:
        yield archive, None, len(content), "archive too large", None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as zipped:
            infos = zipped.infolist()
            if max_files is not None and len(infos) > max_files:
                yield archive, None, len(infos), "too many files", None
                return
            if any(_escapes(i.filename) for i in infos):
                yield archive, None, len(infos), "path outside archive", None
                return
            for info in infos:
                if not info.is_dir():
                    if max_bytes is not None and info.file_size > max_bytes:
                        yield archive, info.filename, info.file_size, "member too large", None
                    else:
                        yield archive, info.filename, info.file_size, "ok", zipped.read(info)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        yield archive, None, len(content), "invalid archive", None


def _escapes(member: str) -> bool:
    path = posixpath.normpath(posixpath.join("/root", member.replace("\\", "/")))
    return path != "/root" and not path.startswith("/root/")


def read_archives(spark: SparkSession, root: str, *, max_bytes: int | None = None,
                  max_files: int | None = None) -> DataFrame:
    """One row per archive member with content and status; refused archives give one row.

    Archives and members are refused for their size only where a limit is given."""
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    names = [part.split()[0] for part in MEMBER_SCHEMA.split(", ")]

    def unpack(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in _members(path, bytes(content), max_bytes, max_files):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    small = archives.select("path", "content") if max_bytes is None else archives.select("path", F.when(F.col("length") <= max_bytes + 1, F.col("content")).otherwise(
        F.substring("content", 1, max_bytes + 1)).alias("content"))
    return small.mapInPandas(unpack, MEMBER_SCHEMA)


def files_of_archives(members: DataFrame, languages=PROJECT_LANGUAGES, skip_dirs=PROJECT_SKIP_DIRS,
                      max_bytes: int | None = None) -> DataFrame:
    """Scannable members as a file table; larger ones are left out only where a limit is given."""
    fits = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    return (members.filter((F.col("status") == "ok") & fits)
            .withColumn("language", language_by_extension(F.col("member"), languages))
            .filter(F.col("language").isNotNull() & ~in_ignored_dir(F.col("member"), skip_dirs))
            .select(F.xxhash64("archive", "member").alias("file_id"), "archive", F.col("member").alias("path"),
                    "language", "size", F.decode("content", "UTF-8").alias("text")))
