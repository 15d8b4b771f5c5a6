"""File scans and sinks: inputs, scripts, marker files, title lists, run reports."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import marker_title, stem_title, strip
from ..operators.ordered import numbered
from ..session import fresh_path

REPORT_SCHEMA = (
    "source string, status string, ratio double, matched bigint, total_source bigint, "
    "issues_count bigint")
# Files in one folder of saved texts; a task lists and writes whole folders.
SHELF_FILES = 1000
LISTED = "at string not null, name string not null, folder boolean not null, length bigint not null"
# What a task lists or reads, and what it hands on at once.
TASK_FILES, TASK_BYTES = 1000, 64 << 20
BATCH_FILES, BATCH_BYTES = 1000, 4 << 20
# Names that Spark's readers pass over.
HIDDEN = r"(?s)^(?:\.|_(?!.*=))|\._COPYING_\z"
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
ONLY_SPARK = r"\.(?:deflate|lz4|snappy)\z"


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files directly below ``folder``, numbered in path order. Reads no content."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return number_inputs(files)


def number_inputs(files: DataFrame) -> DataFrame:
    """Keep supported extensions and number files (path, length) in path order."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = "|".join(e[1:] for e in K.INPUT_EXTENSIONS)
    wanted = files.withColumn("name", name).filter(F.lower("name").rlike(rf"\.({kinds})$"))
    titled = wanted.withColumn("title", stem_title(F.regexp_replace("name", r"\.[^.]+$", "")))
    return numbered(titled, [], ["path"], "position")


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row per file with its whole text; a file is one chapter or script.

    Tasks list the folders and open the files, so the driver holds neither the names nor a split for each of them. Where only
    Spark reaches the store or unpacks a file, its own reader takes over, whose list of files is the driver's.
    """
    from pyarrow.fs import FileSystem

    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    # As Spark writes paths, without slashes for a host that is not there.
    root = target.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri().toString().replace(":///", ":/")
    try:
        FileSystem.from_uri(root)
    except (OSError, ValueError, NotImplementedError):
        return _spark_texts(spark, folder, glob)
    if not store.exists(target):
        raise FileNotFoundError(root)
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    files = list_files(spark, root).filter(F.col("name").rlike(rf"\A(?:{wanted})\z"))
    if not files.filter(F.col("name").rlike(ONLY_SPARK)).isEmpty():
        return _spark_texts(spark, folder, glob)
    return open_texts(files, root)


def _spark_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(
        folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"),
                                       F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files (at, name, length) at any depth below the URI ``root``, without hidden and empty ones, as Spark's readers take them.

    One level of folders after the other is listed by tasks into a table.
    """
    from pyarrow.fs import FileSystem, FileType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        filesystem, _ = FileSystem.from_uri(root)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = filesystem.get_file_info(FileSelector(at))
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "at": pa.array([f.path for f in part], pa.string()),
                        "name": pa.array([f.base_name for f in part], pa.string()),
                        "folder": pa.array([f.type == FileType.Directory for f in part], pa.bool_()),
                        "length": pa.array([f.size or 0 for f in part], pa.int64())})

    filesystem, base = FileSystem.from_uri(root)
    top = filesystem.get_file_info(base)
    path, depth = fresh_path(spark, "listing"), 0
    level = spark.createDataFrame([(base, top.base_name, top.type == FileType.Directory, top.size or 0)], LISTED)
    level.write.parquet(f"{path}/level=0")
    folders = int(top.type == FileType.Directory)
    while folders:
        below = level.filter("folder").select("at").repartition(_tasks(spark, folders)).mapInArrow(run, LISTED)
        depth += 1
        below.filter(~F.col("name").rlike(HIDDEN)).write.parquet(f"{path}/level={depth}")
        level = spark.read.schema(LISTED).parquet(f"{path}/level={depth}")
        folders = level.filter("folder").count()
    return spark.read.schema(LISTED).parquet(path).filter("not folder and length > 0").select("at", "name", "length")


def open_texts(files: DataFrame, root: str) -> DataFrame:
    """Path, as Spark writes it, and whole text of ``files`` (at, length) below the URI ``root``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        filesystem, base = FileSystem.from_uri(root)
        paths, texts, size = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.binary())})

        for batch in batches:
            for at in batch.column(0).to_pylist():
                text = _whole(filesystem, at)
                paths.append(root if at == base else f"{root.rstrip('/')}/{_encoded(at[len(base):].lstrip('/'))}")
                texts.append(text)
                size += len(text)
                if len(paths) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield rows()
                    paths, texts, size = [], [], 0
        yield rows()

    total = files.agg(F.count("*").alias("n"), F.sum("length").alias("length")).first()
    dealt = files.select("at").repartition(_tasks(files.sparkSession, total.n, total.length or 0))
    return dealt.mapInArrow(run, "path string not null, text binary").select("path", F.col("text").cast("string").alias("text"))


def _tasks(spark: SparkSession, files: int, length: int = 0) -> int:
    most = max(spark.sparkContext.defaultParallelism, math.ceil(files / TASK_FILES), math.ceil(length / TASK_BYTES))
    return max(1, min(files, most))


def _whole(filesystem, at: str) -> bytes:
    """Content of a file, unpacked as its ending says."""
    with filesystem.open_input_stream(at, compression=CODECS.get(at[at.rfind("."):])) as f:
        return f.read()


def _encoded(path: str) -> str:
    """A path in a URI as Java writes it: letters of any script stay."""
    return re.sub(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\x9f]|\s""", lambda m: quote(m[0]), path)


def write_texts(rows: DataFrame, folder: str) -> None:
    """One file for every name among ``rows`` (name, text), below ``folder``; rows of one name are its lines.

    Each task writes its files itself under their own names, many to a folder, so nothing is left for the driver to move
    file by file. A file gets its name once it is whole; a task that runs again writes the same files again.
    """
    shelves = max(1, math.ceil(rows.count() / SHELF_FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        filesystem, root = FileSystem.from_uri(folder)
        attempt, shelf, name, out, written = TaskContext.get().taskAttemptId(), None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                filesystem.move(f"{root}/{shelf:06d}/_{attempt}-{name}", f"{root}/{shelf:06d}/{name}")

        for batch in batches:
            for at, called, text in zip(*batch.columns):
                if (at.as_py(), called.as_py()) != (shelf, name):
                    close()
                    if at.as_py() != shelf:
                        filesystem.create_dir(f"{root}/{at.as_py():06d}", recursive=True)
                    shelf, name = at.as_py(), called.as_py()
                    out = filesystem.open_output_stream(f"{root}/{shelf:06d}/_{attempt}-{name}")
                    written += 1
                out.write(text.as_buffer() or b"")
                out.write(b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    shelf = F.pmod(F.xxhash64("name"), F.lit(shelves)).cast("int")
    named = rows.select(shelf.alias("shelf"), "name", "text")
    # Rows of a file meet in one task, one after the other.
    dealt = named.repartition("shelf").sortWithinPartitions("shelf", "name")
    dealt.mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def read_scripts(texts: DataFrame) -> DataFrame:
    """Saved scripts: the episode number comes from the name; other files are skipped."""
    number = F.regexp_extract("path", r"episode_(\d+)_script\.txt", 1).try_cast("int")
    return texts.withColumn("episode_no", number.cast("bigint")).filter("episode_no is not null")


def load_titles(value: Column) -> Column:
    """Titles from a saved JSON list; anything but a list of strings gives an empty list."""
    doc = F.try_parse_json(value)
    strings = F.schema_of_variant(doc) == "ARRAY<STRING>"
    titles = F.from_json(value, "array<string>")
    whole = ~F.exists(F.coalesce(titles, F.array().cast("array<string>")), lambda t: t.isNull())
    return F.when(strings & whole, titles).otherwise(F.array().cast("array<string>"))


def save_titles(df: DataFrame, key: str, pos: str, title: str) -> DataFrame:
    """Title list per chapter file as JSON."""
    rows = F.array_sort(F.collect_list(F.struct(pos, title)))
    return df.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r[title])).alias("titles"))


def parse_markers(body: Column) -> Column:
    """Titles of the marker blocks in a marker file, in order; ``Chapter i`` where one is blank."""
    closed = F.concat(body, F.lit("\n"))
    blocks = F.regexp_extract_all(
        closed, F.lit(r"(?s)\[CHAPTER\][\s]*\n(.*?)\n(?=\[CHAPTER\]|\z)"), F.lit(1))

    def title(block: Column, i: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip),
                         lambda line: F.startswith(F.upper(line), F.lit("TITLE=")))
        last = F.when(F.size(lines) > 0, F.substring(F.element_at(lines, -1), 7, 1 << 30))
        fallback = F.concat(F.lit("Chapter "), (i + 1).cast("string"))
        return F.coalesce(F.nullif(last, F.lit("")), fallback)

    return F.transform(blocks, title)


def marker_block(title: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.concat(
        F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), start_ms.cast("string"), F.lit("\nEND="),
        end_ms.cast("string"), F.lit("\ntitle="), marker_title(title), F.lit("\n"))


def marker_rows(offsets: DataFrame, title: Column) -> DataFrame:
    """Marker file lines per book: block 0 is the header, then one block per episode.

    Blocks stay rows (written in order by a range-partitioned sink), so the length of a book
    does not matter.
    """
    blocks = offsets.select("book_id", F.col("episode_no").cast("bigint").alias("block_no"),
                            marker_block(title, F.col("start_ms"), F.col("end_ms")).alias("block"))
    head = offsets.select("book_id").distinct().select(
        "book_id", F.lit(0).cast("bigint").alias("block_no"), F.lit(K.MARKER_HEADER).alias("block"))
    return blocks.unionByName(head)


def write_markers(rows: DataFrame, path: str) -> None:
    """One folder per book; its files in name order, line after line, are the marker file."""
    lines = rows.withColumn("block", F.regexp_replace("block", r"\n\z", ""))
    lines.repartitionByRange("book_id", "block_no").sortWithinPartitions(
        "book_id", "block_no").select("book_id", "block").write.mode("overwrite").partitionBy(
        "book_id").text(path)


def write_reports(reports: DataFrame, path: str, by: str | None = None) -> None:
    writer = reports.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run report rows with a fixed schema; absent keys become nulls."""
    return spark.read.schema(REPORT_SCHEMA).json(path, multiLine=multi_line)


def decode_bytes(raw: Column) -> tuple[Column, Column]:
    """(text, replaced): UTF-8 with replacement characters and how many were needed."""
    text = F.make_valid_utf8(raw.cast("string"))
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return text, bad.cast("bigint")


def multipart_files(files: DataFrame) -> DataFrame:
    """Files (dir, name) with their part group, part number (0: not a part) and index in it."""
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    part = F.regexp_extract("name", r"(?i)_part(\d+)\.[^.]*$", 1).try_cast("bigint")
    marked = files.withColumns({
        "part_no": F.coalesce(part, F.lit(0).cast("bigint")),
        "multipart": part.isNotNull(),
        "grp": F.when(part.isNotNull(), F.lower(F.concat(
            F.regexp_replace(stem, r"(?i)_part\d+$", ""),
            F.regexp_extract("name", r"(\.[^.]*)$", 1)))).otherwise(F.col("name"))})
    return numbered(marked, ["dir", "grp", "multipart"], ["part_no", "name"], "part_index")
