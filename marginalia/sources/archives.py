"""ZIP archives as a data source: written in parts by tasks with commit and abort, read member by member below a byte cap.

A task writes whole archives to a staging folder; they are moved to their place
when every task has ended well, so a failed job leaves none. A reader takes
some archives a partition, decides by the directory at the archive's end whether a
member is wanted and small enough, and only then reads its bytes.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from marginalia.operators.names import running_total, unique_names
from marginalia.session import dropped

FORMAT = "marginalia_archive"
#: A member of more bytes is told of, but not read.
CAP = 5 << 20
#: Text that one archive holds at most, but for its last member; what is more goes to further volumes of the batch.
VOLUME_BYTES = 256 << 20
#: Bytes of members that a reader holds before it hands them on.
BATCH_BYTES = 4 << 20
#: Bytes of archives that one partition reads; a larger archive is a partition of its own.
PARTITION_BYTES = 32 << 20
MEMBERS = pa.schema([("archive", pa.string()), ("name", pa.string()), ("bytes", pa.int64()), ("too_large", pa.bool_()), ("body", pa.binary())])
MEMBER_DDL = "archive string, name string, bytes long, too_large boolean, body binary"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Archives(InputPartition):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (archive, name, body), those of one archive one after another in one partition."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _located(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt alone
        where.create_dir(folder, recursive=True)
        files, current, sink, archive = [], None, None, None
        try:
            for batch in iterator:
                for name, member, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("archive", "name", "body"))):
                    if name != current:
                        if archive is not None:
                            archive.close(), sink.close()
                        if name in files:
                            raise ValueError(f"rows of archive {name} are scattered")
                        sink = where.open_output_stream(f"{folder}/{name}")
                        archive, current = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED), name
                        files.append(name)
                    # A fixed time, so that equal rows make equal archives.
                    archive.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), body or b"", zipfile.ZIP_DEFLATED)
        finally:
            if archive is not None:
                archive.close(), sink.close()
        return Written([f"{folder}/{name}" for name in files])

    def commit(self, messages: list[Written | None]) -> None:
        where, root = _located(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f.rsplit("/", 1)[1] for f in files]
        if len(set(names)) < len(names):
            raise ValueError("an archive was written by two tasks")
        held = {f.base_name for f in where.get_file_info(fs.FileSelector(root))}
        if self.overwrite:
            for name in held:
                if name.endswith(".zip"):
                    where.delete_file(f"{root}/{name}")
        elif held & set(names):
            raise FileExistsError(f"{min(held & set(names))} is there already")
        for file, name in zip(files, names):
            where.move(file, f"{root}/{name}")
        where.delete_dir(f"{root}/{self.staging}") if self.staging in held else None
        where.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        where, root = _located(self.path)
        staging = f"{root}/{self.staging}"
        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, cap: int) -> None:
        self.path, self.cap, self.archives, self.names = path, cap, None, None

    def pushFilters(self, filters):
        """Equality and IN on archive and name choose what is opened; Spark applies the rest."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("archive",):
                self.archives = wanted if self.archives is None else self.archives & wanted
            elif wanted is not None and f.attribute == ("name",):
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[Archives]:
        where, root = _located(self.path)
        found = sorted((f.base_name, f.size) for f in where.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".zip") and not f.base_name.startswith("_"))
        parts, held = [], PARTITION_BYTES
        for file, size in found:
            if self.archives is not None and file not in self.archives:
                continue
            if held + size > PARTITION_BYTES:
                parts.append(Archives([]))
                held = 0
            parts[-1].files.append(file)
            held += size
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        where, root = _located(self.path)
        held, size = [], 0
        for file in partition.files:
            with where.open_input_file(f"{root}/{file}") as source, zipfile.ZipFile(source) as archive:
                for member in archive.infolist():
                    if self.names is not None and member.filename not in self.names:
                        continue
                    large = member.file_size > self.cap
                    held.append((file, member.filename, member.file_size, large, None if large else archive.read(member)))
                    size += 0 if large else member.file_size
                    if size > BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), MEMBERS.types)], schema=MEMBERS)


class ArchiveSource(DataSource):
    """``path``: the folder of archives; ``cap``: the byte cap of members."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEMBER_DDL

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("cap", CAP)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def archive_name(batch: Column, volume: Column) -> Column:
    """Different for different batches and volumes: the batch's text, percent-encoded, and the volume's number from the second on."""
    text = F.replace(F.url_encode(batch.cast("string")), F.lit("+"), F.lit("%20"))
    return F.concat(F.when(text == "", "%").otherwise(F.coalesce(text, F.lit("+"))), F.when(volume > 0, F.concat(F.lit("+"), (volume + 1).cast("string"))).otherwise(""), F.lit(".zip"))


def write_archives(df: DataFrame, path: str, batch: str, order: str, title: str = "title", markdown: str = "markdown", volume_bytes: int = VOLUME_BYTES, mode: str = "append") -> None:
    """An archive for each batch's rows with ``success``, under unique names in ``order``; batches without any get none.

    A batch of more than ``volume_bytes`` gets further volumes, so no task writes an unbounded one. ``order`` is not
    null and tells the rows of a batch apart; two rows equal in both are an error. Texts do not travel
    while rows are named and put into volumes: they join their names and go to the task that writes them.
    """
    good = df.where("success").select(F.col(batch).alias("batch"), F.col(order).alias("pos"), F.col(title).alias("title"), F.encode(F.coalesce(markdown, F.lit("")), "UTF-8").alias("body"))
    named = unique_names(good.select("batch", "pos", "title", F.octet_length("body").alias("size")), "batch", "pos")
    if not named.groupBy("batch", "pos").count().where("count > 1").isEmpty():
        raise ValueError(f"rows of a batch are equal in {order}")
    sized, placed = running_total(named, ["batch"], ["pos"], F.col("size"), "start")
    volume = F.floor(F.col("start") / volume_bytes).cast("long")
    places = sized.select(F.col("batch").alias("batch2"), F.col("pos").alias("pos2"), "name", archive_name(F.col("batch"), volume).alias("archive"))
    rows = good.select("batch", "pos", "body").join(places, F.col("batch").eqNullSafe(F.col("batch2")) & (F.col("pos") == F.col("pos2")))
    spread = rows.repartition("archive").sortWithinPartitions("archive", "pos").select("archive", "name", "body")
    df.sparkSession.dataSource.register(ArchiveSource)
    spread.write.format(FORMAT).mode(mode).option("path", path).save()
    dropped(named, placed)


def read_archives(spark: SparkSession, path: str, cap: int = CAP) -> DataFrame:
    """(archive, name, bytes, too_large, body) of every member; the body of one beyond ``cap`` is null and is not read.

    Filters on archive and name reach the reader; the session's setting for that is switched on.
    """
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("cap", str(cap)).option("path", path).load()
