"""One reader for every file source, batch and stream: ``spark.read`` and ``spark.readStream`` with ``format("archive")``.

Options: ``path``; ``kind`` (mail, bank, letter, invoice); ``days`` ("true" where the path holds day-01, day-02, ...
folders, each with a folder for the kind); ``cursor`` (of a stream: a file that keeps its day). A batch reads every
file. A stream's offset is the day: with a cursor each batch has one day, without one all
days since the last batch, and one that fails is run again for the same days. Files are dealt out by their bytes. ``events``
makes the common event rows of either. What can't be read comes as a row with an error, for ``broken``.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerloom.sources import files, schemas, tables

FOLDERS = {"mail": "emails", "bank": "bank", "letter": "briefe", "invoice": "rechnungen"}
SUFFIX = {"mail": ".eml", "bank": ".csv", "letter": ".pdf", "invoice": ".pdf"}
BYTES = 64 << 20  # of the files of one partition, about
OPEN = 64 << 10  # bytes that opening a file counts as, so that many small files are many partitions
_FILE = "day int, path string, modified timestamp, error string"
_SCAN = "name string, sha256 string, length long"
_MAIL = schemas.EML_FIELDS.removesuffix(", error string")
SCHEMAS = {"mail": f"{_FILE}, {_MAIL}", "bank": f"{_FILE}, {schemas.BANK}", "letter": f"{_FILE}, {_SCAN}", "invoice": f"{_FILE}, {_SCAN}"}


@dataclass
class Files(InputPartition):
    #: (day or None, path, time of change)
    files: list

    def __init__(self, files: list):
        self.files = files


def _system(path: str):
    import pyarrow.fs as fs

    if re.match("file:/+", path):
        path = "/" + re.sub("^file:/+", "", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def cursor(path: str) -> int:
    """The day that a cursor stands on, 0 where there is none."""
    import pyarrow.fs as fs

    system, where = _system(path)
    if system.get_file_info(where).type == fs.FileType.NotFound:
        return 0
    with system.open_input_stream(where) as f:
        return int(f.read() or b"0")


def set_cursor(path: str, day: int) -> None:
    """Put a cursor on a day; 0 starts anew."""
    system, where = _system(path)
    with system.open_output_stream(where) as f:
        f.write(str(day).encode())


class _Archive:
    def __init__(self, options: dict):
        self.root, self.kind, self.days = options["path"].rstrip("/"), options["kind"], options.get("days", "false") == "true"

    def listed(self, after: int | None = None, upto: int | None = None) -> list[tuple]:
        """(day, path, modified, bytes) of the files of the kind, in order; of days in (after, upto]."""
        import pyarrow.fs as fs

        system, root = _system(self.root)
        out = []
        for day, folder in self.folders(after, upto):
            for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
                if info.is_file and info.path.lower().endswith(SUFFIX[self.kind]):
                    out.append((day, info.path, info.mtime.astimezone(UTC), info.size))
        return sorted(out, key=lambda x: (x[0] or 0, x[1]))

    def folders(self, after: int | None, upto: int | None) -> list[tuple]:
        system, root = _system(self.root)
        if not self.days:
            return [(None, root)]
        return [(n, f"{root}/day-{n:02d}/{FOLDERS[self.kind]}") for n in self.numbers() if (after is None or n > after) and (upto is None or n <= upto)]

    def numbers(self) -> list[int]:
        """The days that are there."""
        import pyarrow.fs as fs

        system, root = _system(self.root)
        names = (x.base_name for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if not x.is_file)
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"day-(\d+)", n)))

    def dealt(self, found: list[tuple]) -> list[Files]:
        out, held = [[]], 0
        for day, path, modified, size in found:
            if out[-1] and held + size + OPEN > BYTES:
                out.append([])
                held = 0
            out[-1].append((day, path, modified))
            held += size + OPEN
        return [Files(x) for x in out if x]

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = _system(self.root)
        for day, path, modified in part.files:
            head = (day, path, modified.replace(tzinfo=UTC) if modified.tzinfo is None else modified)
            try:
                with system.open_input_stream(path) as f:
                    yield from self.parsed(head, f.read())
            except (OSError, UnicodeDecodeError, csv.Error) as e:
                yield self.failed(head, f"{type(e).__name__}: {e}"[:500])

    def failed(self, head: tuple, error: str) -> tuple:
        return (*head, error, *(None for _ in SCHEMAS[self.kind].split(", ")[4:]))

    def parsed(self, head: tuple, raw: bytes) -> Iterator[tuple]:
        if self.kind == "mail":
            m = files.parse_mail(raw)
            names = [f.split()[0] for f in _MAIL.split(", ")]
            yield self.failed(head, m["error"]) if m["error"] else (*head, None, *(m[n] for n in names))
        elif self.kind == "bank":
            names = [f.split()[0] for f in schemas.BANK.split(", ")]
            for row in csv.DictReader(io.StringIO(raw.decode("utf-8-sig"), newline="")):
                yield (*head, None, *(row.get(n) or None for n in names))
        else:
            yield (*head, None, head[1].rpartition("/")[2], hashlib.sha256(raw).hexdigest(), len(raw))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.archive = _Archive(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.archive.dealt(self.archive.listed()) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.archive.rows(partition)


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.archive, self.cursor = _Archive({**options, "days": "true"}), options.get("cursor")

    def initialOffset(self) -> dict:
        return {"day": 0}

    def latestOffset(self) -> dict:
        days = self.archive.numbers()
        at = cursor(self.cursor) if self.cursor else None
        return {"day": max(days, default=0) if at is None else next((n for n in days if n > at), at)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # Spark has logged ``end`` by now, and runs this batch again before it asks for another one
        if self.cursor and end["day"] > cursor(self.cursor):
            set_cursor(self.cursor, end["day"])
        return self.archive.dealt(self.archive.listed(start["day"], end["day"])) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.archive.rows(partition)


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archive)


def pull(spark: SparkSession, path: str, kind: str, days: bool = False) -> DataFrame:
    """All rows of a source; a missing path has none."""
    register(spark)
    return spark.read.format("archive").option("kind", kind).option("days", str(days).lower()).load(path)


def stream(spark: SparkSession, path: str, kind: str, cursor: str | None = None) -> DataFrame:
    """The rows of a source's day folders as they come, a day at a time if a file for its ``cursor`` is named."""
    register(spark)
    rows = spark.readStream.format("archive").option("kind", kind).option("path", path)
    return (rows.option("cursor", cursor) if cursor else rows).load()


def events(rows: DataFrame, kind: str) -> DataFrame:
    """The common event rows of what was read; rows with an error are left out, see ``broken``."""
    good = rows.where("error is null")
    if kind == "mail":
        return files.mail_events(good.withColumn("modificationTime", F.col("modified")))
    if kind == "bank":
        return tables.bank_events(good)
    return files.scan_events(good, kind, F.col("sha256"))


def broken(rows: DataFrame) -> DataFrame:
    """Dead letters: files that couldn't be read."""
    return rows.where("error is not null").select("day", "path", "error")
