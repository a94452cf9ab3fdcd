"""JSON documents of any size, one file per key.

A document is a table of lines (key, section, part, place, text, opens, closes), in that order. The lines are range-partitioned, so a
large document is sorted and rendered by many tasks; each of them streams its lines into a file of its own. A commit step
names the files of the tasks that counted, and a second pass joins the files of each document as a stream of bytes. Neither a task
nor the driver holds a document, and what the driver sees are two file names per task. Parts are written as gzip members of some
megabytes of lines and removed when the documents stand. Documents are plain text, or with ``compressed`` those members as they
are: one gzip file per document, whose members are listed, so that many tasks read a large one. Sections may be written one pass after
the other; the shuffle files of a pass are gone before the next one begins.

Each line is a line of the file, so documents can be read back in splits (`read_lines`). Between two lines of one section
stands a comma, unless the first one opens something or the second one closes it.
"""

from __future__ import annotations

import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from vulnlake.operators.scale import shuffles_removed

COPY_BYTES = 8 << 20
MEMBER_BYTES = 8 << 20  # of text, before compression


def _file_system(path: str):
    """(file system, path on it) of a path or URI that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def file_name(key: str, compressed: bool = False) -> str:
    """A key's file; letters that names should not hold are written as =XX, as Spark encodes a % once more."""
    return quote(key, safe="").replace("%", "=") + (".json.gz" if compressed else ".json")


class _Members:
    """Text as gzip members in an open file."""

    def __init__(self, stream):
        self.stream, self.at, self.packer = stream, 0, None
        self.begin = self.plain = 0

    def write(self, data: bytes) -> None:
        if self.packer is None:
            self.packer, self.begin, self.plain = zlib.compressobj(6, wbits=31), self.at, 0
        self._out(self.packer.compress(data))
        self.plain += len(data)

    def _out(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def ended(self) -> list[dict]:
        """Ends the member that is being written, and tells its place; nothing if there is none."""
        if self.packer is None:
            return []
        self._out(self.packer.flush())
        self.packer = None
        return [{"begin": self.begin, "size": self.at - self.begin}]


class _Message(WriterCommitMessage):
    def __init__(self, listing: str):
        self.listing = listing


class LinesWriter(DataSourceArrowWriter):
    """Writes sorted lines of documents as the parts of one task, and lists these parts in a file."""

    def __init__(self, path: str, first: int = 0):
        self.path, self.first = path, first

    def write(self, batches: Iterator) -> _Message:
        rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)], strict=True))
        files, root = _file_system(self.path)
        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{uuid.uuid4().hex}"
        files.create_dir(f"{root}/_parts", recursive=True)
        listed, out, key, last = [], None, None, None
        with files.open_output_stream(f"{root}/_parts/{name}") as file:
            stream = _Members(file)
            for own, section, _part, _place, text, opens, closes in rows:
                if out is None or own != key:
                    if out is not None:
                        out |= {"last_section": last[0], "opens": last[1], "members": out["members"] + stream.ended()}
                    key = own
                    out = {"key": key, "task": self.first + task.partitionId(), "name": name, "section": section, "closes": closes, "members": []}
                    listed.append(out)
                    last = None
                if last is not None:
                    stream.write(b",\n" if last[0] == section and not last[1] and not closes else b"\n")
                    if stream.plain >= MEMBER_BYTES:
                        out["members"] += stream.ended()
                stream.write(text.encode())
                last = (section, opens)
            if out is not None:
                out |= {"last_section": last[0], "opens": last[1], "members": out["members"] + stream.ended()}
        with files.open_output_stream(f"{root}/_parts/{name}.json") as stream:
            stream.write("".join(json.dumps(part) + "\n" for part in listed).encode())
        return _Message(f"{name}.json")

    def commit(self, messages) -> None:
        files, root = _file_system(self.path)
        files.create_dir(f"{root}/_listed", recursive=True)
        for message in messages:
            if message is not None:
                files.move(f"{root}/_parts/{message.listing}", f"{root}/_listed/{message.listing}")

    def abort(self, messages) -> None:
        """What failed attempts wrote is in no list and is never read."""


LINE = "key string, section int, part string, place bigint, text string, opens boolean, closes boolean"


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_lines"

    def schema(self) -> str:
        return LINE

    def writer(self, schema, overwrite) -> LinesWriter:
        return LinesWriter(self.options["path"], int(self.options.get("first", 0)))


MEMBERS = "array<struct<begin:bigint,size:bigint>>"
PART = f"key string, task int, name string, section int, closes boolean, last_section int, opens boolean, members {MEMBERS}"
DOCUMENT = f"key string, bytes bigint, members {MEMBERS}"


def _copied(source, members: list[dict], out, compressed: bool) -> list[dict]:
    """Appends the members of a part, which follow each other, to a document, and tells where they are in it."""
    source.seek(members[0]["begin"])
    start = out.tell() - members[0]["begin"]
    for member in members:
        left, unpacker = member["size"], None if compressed else zlib.decompressobj(wbits=31)
        while left:
            data = source.read(min(left, COPY_BYTES))
            left -= len(data)
            out.write(data if compressed else unpacker.decompress(data))
    return [{"begin": start + m["begin"], "size": m["size"]} for m in members] if compressed else []


def _joined(path: str, compressed: bool):
    def documents(batches):
        import pyarrow as pa

        files, root = _file_system(path)
        between = (lambda data: gzip.compress(data, 6, mtime=0)) if compressed else bytes
        for batch in batches:
            keys, sizes, places = [], [], []
            for row in batch.to_pylist():
                parts = sorted(row["parts"], key=lambda p: p["task"])
                temporary = f"{root}/_parts/{uuid.uuid4().hex}"
                members = []
                with files.open_output_stream(temporary) as out:
                    for i, part in enumerate(parts):
                        if i:
                            before = parts[i - 1]
                            comma = before["last_section"] == part["section"] and not before["opens"] and not part["closes"]
                            out.write(between(b",\n" if comma else b"\n"))
                        with files.open_input_file(f"{root}/_parts/{part['name']}") as source:
                            members += _copied(source, part["members"], out, compressed)
                    out.write(between(b"\n"))
                    sizes.append(out.tell())
                files.move(temporary, f"{root}/{file_name(row['key'], compressed)}")
                keys.append(row["key"])
                places.append(members)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(sizes, pa.int64()),
                 pa.array(places, pa.list_(pa.struct([("begin", pa.int64()), ("size", pa.int64())])))], ["key", "bytes", "members"])

    return documents


def write_documents(lines: DataFrame, path: str, compressed: bool = False, passes: tuple[int, ...] = (), shares: int = 1) -> DataFrame:
    """Writes ``path``/`file_name(key)` for every key of ``lines``; returns (key, bytes). The folder must be new.

    ``passes`` are the sections with which a new pass begins, and each pass has ``shares`` of the keys one after the other: only
    what is written in one of these steps is shuffled at a time."""
    spark = lines.sparkSession
    spark.dataSource.register(LinesSource)
    order = ["key", "section", "part", "place"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("key"), F.lit(shares))
    for number, (low, high, turn) in enumerate((low, high, turn) for low, high in zip([None, *passes], [*passes, None]) for turn in range(shares)):
        own = lines if low is None else lines.filter(F.col("section") >= low)
        own = own if high is None else own.filter(F.col("section") < high)
        own = own if shares == 1 else own.filter(share == turn)
        ordered = own.select(*[c.split()[0] for c in LINE.split(", ")]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        with shuffles_removed(spark):
            ordered.write.format("document_lines").mode("append").option("path", path).option("first", number << 20).save()
    listed = spark.read.schema(PART).json(f"{path}/_listed")
    grouped = listed.groupBy("key").agg(F.collect_list(F.struct("task", "name", "section", "closes", "last_section", "opens", "members")).alias("parts"))
    done = grouped.mapInArrow(_joined(path, compressed), DOCUMENT)
    done.write.mode("overwrite").json(f"{path}/_documents")
    files, root = _file_system(path)
    files.delete_dir(f"{root}/_parts")
    return spark.read.schema("key string, bytes bigint").json(f"{path}/_documents")


def _unpacked(path: str):
    def read(batches):
        import pyarrow as pa

        files, root = _file_system(path)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_file(f"{root}/{file_name(row['key'], True)}") as source:
                    text = gzip.decompress(source.read_at(row["size"], row["begin"]))
                found = text.decode().removesuffix("\n").split("\n")
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["key"], pa.string()), len(found)), pa.array(found, pa.string())], ["key", "value"])

    return read


def read_lines(spark: SparkSession, path: str, compressed: bool = False) -> DataFrame:
    """(key, text) of the lines of all documents in a folder, without the commas between them."""
    if compressed:
        members = spark.read.schema(DOCUMENT).json(f"{path}/_documents").select("key", F.inline("members"))
        dealt = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = dealt.mapInArrow(_unpacked(path), "key string, value string")
    else:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
        rows = spark.read.option("pathGlobFilter", "*.json").text(path).select(F.url_decode(F.replace(name, F.lit("="), F.lit("%"))).alias("key"), F.col("value"))
    return rows.select("key", F.regexp_replace("value", ",$", "").alias("text"))


def lines(frame: DataFrame, key: str, section: int, text: Column, place: Column, part: Column | None = None, opens: Column | bool = False,
          closes: Column | bool = False) -> DataFrame:
    """Rows of a document table from rows of any frame."""
    flag = lambda value: F.lit(value) if isinstance(value, bool) else value
    return frame.select(
        F.col(key).cast("string").alias("key"), F.lit(section).alias("section"), (F.lit("") if part is None else part).alias("part"),
        place.cast("bigint").alias("place"), text.alias("text"), flag(opens).alias("opens"), flag(closes).alias("closes"))


def frame_lines(keys: DataFrame, key: str, texts: dict[int, str | Column]) -> DataFrame:
    """The fixed lines of every document: a text for each of some sections."""
    rows = F.array(*[F.struct(F.lit(s).alias("section"), (F.lit(x) if isinstance(x, str) else x).alias("text")) for s, x in texts.items()])
    return keys.select(F.col(key).cast("string").alias("key"), F.inline(rows)).select(
        "key", "section", F.lit("").alias("part"), F.lit(0).cast("bigint").alias("place"), "text", F.lit(False).alias("opens"), F.lit(False).alias("closes"))

