"""Recorded files: segments in the order in which they were made, logs by session, and frames as the badges send them."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "path string, modificationTime timestamp, length long, content binary"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trailing_number(path: Column) -> Column:
    """The whole number that ends a file's name before its suffix (segment_10.wav: 10); null if none does."""
    return F.nullif(F.regexp_extract(file_name(path), r"_(\d+)\.[^.]*$", 1), F.lit("")).cast("long")


def recordings(spark: SparkSession, path: str, suffix: str = ".wav", stream: bool = False) -> DataFrame:
    """Files below path with this ending: path, session (their folder), name, no (trailing number), modified, length,
    content. What isn't selected isn't read, files of no bytes are passed over. As a stream files come in order of their modification."""
    reader = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1) if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("session"), file_name(F.col("path")).alias("name"), trailing_number(F.col("path")).alias("no"), F.col("modificationTime").alias("modified"), "length", "content")


def replayed(files: DataFrame, by: str = "modified") -> DataFrame:
    """Files of each session with their place in the replay: by modification (of equal times by name), or by trailing
    number (no), so that 10 comes after 9; files without a number come last."""
    order = [F.col("no").asc_nulls_last(), "name"] if by == "no" else ["modified", "name"]
    return files.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(*order)))


def log_of_session(files: DataFrame, ending: str) -> DataFrame:
    """Of each session the last file, by name, with this ending; sessions without one have no row."""
    return files.where(F.endswith("name", F.lit(ending))).groupBy("session").agg(F.max_by(F.struct("*"), "name").alias("row")).select("row.*")


def frame_rate(frames: DataFrame, every: int = 30) -> DataFrame:
    """Frames a second over each ``every`` frames of a source: source, no (of the stretch), fps. frames: source, time in
    seconds. A stretch that isn't full has no row; its time runs from the last frame of the one before (the first: its own)."""
    w = Window.partitionBy("source").orderBy("time")
    f = frames.select("source", "time", F.row_number().over(w).alias("k"), F.lag("time", 1).over(w).alias("before"))
    g = f.groupBy("source", F.floor((F.col("k") - 1) / every).alias("no")).agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("end"), F.min(F.coalesce("before", "time")).alias("start"))
    return g.where(F.col("n") == every).select("source", "no", (F.lit(float(every)) / F.nullif(F.col("end") - F.col("start"), F.lit(0.0))).alias("fps"))


#: A frame: packet counter; year, month, day, hour, minute, second, millisecond; 512 samples of 16 bits.
HEADER = struct.Struct(">I7H")
SAMPLES = 512
FRAME = HEADER.size + 2 * SAMPLES


class Frames(DataSource):
    """Recorded frame files as a source: spark.read.format("frames").load(file or folder). Options: splitBytes.

    Paths are local or have a scheme that Arrow's file systems know. A split takes the frames that begin in its range of
    bytes, so any size of split gives the same rows. A frame that a file's end cuts short is left out."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, at long, counter long, time timestamp, pcm binary"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


class Split(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[Split]:
        import pyarrow.fs as pafs

        fs, root = opened(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Split(path, low, min(low + self.size, size)) for path, size in files for low in range(0, size, self.size)]

    def read(self, split: Split) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        with fs.open_input_file(split.path) as file:
            for at in range(-(-split.low // FRAME) * FRAME, split.high, FRAME):
                data = file.read_at(FRAME, at)
                if len(data) < FRAME:
                    return
                counter, year, month, day, hour, minute, second, ms = HEADER.unpack_from(data)
                yield split.path, at, counter, datetime(year, month, day, hour, minute, second, ms * 1000, UTC), data[HEADER.size :]


def opened(path: str):
    """The file system of a path, local or by its scheme, and the path in it."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def gaps(frames: DataFrame) -> DataFrame:
    """Where counters jump: path, after (the last counter before), lost (how many frames are missing; 32-bit counters
    start again at 0)."""
    before = F.lag("counter").over(Window.partitionBy("path").orderBy("at"))
    lost = F.pmod(F.col("counter") - F.col("after") - 1, F.lit(2**32))
    return frames.withColumn("after", before).where("after is not null").select("path", "after", lost.alias("lost")).where("lost > 0")
