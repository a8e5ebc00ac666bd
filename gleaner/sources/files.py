"""Ingest of directories: listing, admission, text decoding and the ledger of skipped files.

The listing (sources.tree) reads no content. What is new by (path, mtime, size) and admitted by
name and size alone is read, file by file where it lies, so a refresh costs the
changed files and no content is ever shuffled. Every entry of the tree is a document, a
directory, unchanged, or a row of the ledger.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import fixed
from gleaner.functions import text as X

from .shared import shared_dir, until_exit
from .tree import local, record_batch, tree


def folder_rows(paths: DataFrame) -> DataFrame:
    """Directories (path) as documents without text; their time is 0, so that a new file does not change those above it."""
    return paths.select("path", F.lit(0.0).alias("mtime"), F.lit(0).cast("long").alias("size"), F.lit("").alias("lang"), F.lit(0).alias("n_lines"), F.lit("").alias("text"), F.lit("dir").alias("method"), F.lit(True).alias("is_dir"))


def directories(files: DataFrame, root: str) -> DataFrame:
    """A row for each directory between ``root`` and a file, the root itself left out."""
    below = F.split(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"), "/")
    names = F.transform(F.sequence(F.lit(1), F.size(below) - 1), lambda i: F.array_join(F.slice(below, 1, i), "/"))
    inner = files.select(below.alias("b"), "path").where(F.size("b") > 1).select(F.explode(names).alias("d")).distinct()
    return folder_rows(inner.select(F.concat(F.lit(root.rstrip("/") + "/"), "d").alias("path")))


def in_skipped_directory(path: Column, include_deps: bool = False, root: str = "") -> Column:
    """Inside a pruned directory below ``root``; with ``include_deps`` only the dotted ones stay pruned."""
    names = [n for n in fixed.SKIP_DIRS if not include_deps or n.startswith(".")]
    parts = F.split(F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)) if root else path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, names)))


def admission(path: Column, size: Column, head: Column | None = None) -> Column:
    """Why a file is taken (ext, known_name, sniffed, media) or skipped (too_large, binary_ext, unknown_ext); the first rule that fits.

    ``head``: its first bytes, for names without an extension; without it these are ``sniffed``.
    """
    name = F.lower(X.base_name(path))
    ext = F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.concat(F.lit("."), F.element_at(F.split(name, "\\."), -1))).otherwise("")
    text_exts = [e for own in fixed.LANGUAGE_EXTS.values() for e in own]
    clean = F.lit(True) if head is None else ~F.coalesce(F.hex(F.substring(head, 1, fixed.SNIFF_BYTES)).rlike("^(..)*00"), F.lit(False))
    return (
        F.when(size > fixed.MAX_FILE_BYTES, "too_large")
        .when(ext.isin(*fixed.SKIP_EXTS), "binary_ext")
        .when(ext.isin(*fixed.MEDIA_EXTS), "media")
        .when(ext.isin(*text_exts), "ext")
        .when(name.isin(*fixed.TEXT_NAMES) | name.startswith(".env"), "known_name")
        .when((ext == "") & clean, "sniffed")
        .otherwise("unknown_ext")
    )


TAKEN = ("ext", "known_name", "sniffed")


def decode(content: bytes | None) -> str:
    """UTF-8 with replacement; over-long lines cut; line ends as newlines."""
    text = (content or b"")[: fixed.MAX_FILE_BYTES].decode("utf-8", "replace")
    return "\n".join(x if len(x) <= fixed.MAX_LINE_CHARS else x[: fixed.MAX_LINE_CHARS] + " …[line truncated]" for x in text.splitlines())


def decoded(content: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def of(content: pd.Series) -> pd.Series:
        return content.map(decode)

    return of(content)


def extract(text: Column, path: Column, media: Column | None = None) -> Column:
    """struct(text, method) for decoded ``text``. ``media`` is an expression for pdf and image text; without one they are reported as unavailable."""
    pdf = F.lower(path).endswith(".pdf")
    image = F.lower(path).rlike("\\.(png|jpe?g|webp|bmp|tiff?|gif)$")
    found = media if media is not None else F.lit("")
    method = F.when(pdf, F.lit("pdftext" if media is not None else "pdf_unavailable")).when(image, F.lit("ocr" if media is not None else "ocr_unavailable")).otherwise("utf8")
    return F.struct(F.when(pdf | image, found).otherwise(text).alias("text"), method.alias("method"))


Read = Callable[[str], bytes]


def opened(path: str) -> bytes:
    """Content of a file in any store that pyarrow reaches (local, hdfs, s3, gs); others take a reader of their own."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    with store.open_input_stream(inner) as f:
        return f.read()


def contents_of(files: DataFrame, read: Read = opened) -> DataFrame:
    """``files`` with ``content``, read by the executors (null where a file is unreadable)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path: str) -> bytes | None:
            try:
                return read(path)
            except OSError:
                return None

        for f in frames:
            for at in range(0, len(f), 64):  # bounded by 64 files of the largest size admitted
                part = f.iloc[at : at + 64]
                yield part.assign(content=part["path"].map(one))

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


#: Files read before their rows go on, and bytes of them.
FILES, BYTES = 1024, 16 << 20


def texts_of(files: DataFrame, read: Read = opened, whole: bool = True, media: bool = False) -> DataFrame:
    """``files`` (path, mtime, size, why) with ``why`` as their content has it and ``text``, read and decoded in one step; ``content`` of pdf files and images, with ``media``.

    Without ``whole`` a text ends after its first character that is no space: enough to tell which files have text.
    """
    schema = pa.schema([("path", pa.string()), ("mtime", pa.float64()), ("size", pa.int64()), ("why", pa.string()), ("text", pa.string()), ("content", pa.binary())])

    def one(path: str, why: str) -> tuple[str, str | None, bytes | None]:
        try:
            content = read(path)
        except OSError:
            return "unreadable", None, None
        if why == "sniffed" and b"\0" in content[: fixed.SNIFF_BYTES]:
            return "unknown_ext", None, None
        if path.lower().endswith(fixed.MEDIA_EXTS):
            return why, None, content if media else None
        text = decode(content)
        return why, text if whole else text.lstrip(" ")[:1], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, mtime, size, why in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = one(path, why)
                rows.append((path, mtime, size, *found))
                held += len(found[1] or "") + len(found[2] or b"")
                if len(rows) >= FILES or held >= BYTES:
                    yield record_batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield record_batch(rows, schema)

    return files.select("path", "mtime", "size", "why").mapInArrow(run, "path string, mtime double, size long, why string, text string, content binary")


def ingest(spark: SparkSession, root: str, known: DataFrame | None = None, include_deps: bool = False, media: Column | None = None, read: Read = opened) -> tuple[DataFrame, DataFrame]:
    """(documents and directories, ledger) of a directory.

    ``known``: path, mtime, size of files that need no reading. ``media``: expression over ``content`` and ``path`` for the text of pdf files and images.
    The tree is listed once, into the shared folder; documents and ledger are of that moment. The ledger reads the files for itself, but no text of them leaves the step that reads.
    """
    at = until_exit(spark, f"{shared_dir(spark)}/gleaner/{uuid.uuid4().hex}")
    tree(spark, root, include_deps).write.parquet(at)
    every = spark.read.parquet(at)
    files = every.where("kind = 'file'").select("path", "mtime", "size")
    if known is not None:
        files = files.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
    judged = files.withColumn("why", admission(F.col("path"), F.col("size")))
    wanted = F.col("why").isin(*TAKEN, *(["media"] if media is not None else []))
    x = extract(F.col("text"), F.col("path"), media)
    taken = F.coalesce(F.trim("x.text") != "", F.lit(False))

    def done(whole: bool) -> DataFrame:
        return texts_of(judged.where(wanted), read, whole, media is not None).withColumn("x", F.when(F.col("why").isin(*TAKEN, "media"), x)).drop("content", "text")

    docs = done(True).where(taken).select(
        F.xxhash64("path").alias("doc_id"), "path", "mtime", "size", X.language_of(F.col("path")).alias("lang"), X.line_count(F.col("x.text")).alias("n_lines"),
        "x.text", "x.method", F.lit(False).alias("is_dir"),
    )
    folders = folder_rows(every.where("kind = 'dir'")).select(F.xxhash64("path").alias("doc_id"), *(c for c in docs.columns if c != "doc_id"))
    why = F.when(F.col("why").isin(*TAKEN, "media"), "no_text_content").otherwise(F.col("why"))
    late = done(False).where(~taken).select("path", "size", why.alias("reason"), F.col("mtime").alias("seen"))
    skipped = judged.where(~wanted).select("path", "size", F.col("why").alias("reason"), F.col("mtime").alias("seen"))
    unlisted = every.where("kind = 'skipped'").select("path", "size", "reason", F.col("mtime").alias("seen"))
    return docs.unionByName(folders), skipped.unionByName(late).unionByName(unlisted)


def pruned(spark: SparkSession, root: str, include_deps: bool = False) -> DataFrame:
    """How many files, and bytes, lie in directories that are left out."""
    base = (local(root) or root).rstrip("/")
    files = tree(spark, root, prune=False).where("kind = 'file'")
    return files.where(in_skipped_directory(F.col("path"), include_deps, base)).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def write_json(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").json(path)


def contents(ledger: DataFrame, most: int = 48 << 20, read: Read = opened) -> DataFrame:
    """path, size, text of skipped files of at most ``most`` bytes, for search.grep; what cannot be read is left out."""
    small = ledger.where(F.col("size") <= most).select("path", "size").distinct()
    return contents_of(small, read).where("content is not null").select("path", "size", decoded(F.col("content")).alias("text"))


#: Sizes up to which skipped files are looked at together, smallest first, and how much of a file is read.
WAVES, READ = (1 << 16, 1 << 20, 1 << 23, 1 << 26, 1 << 62), 48 << 20


def grep_within(spark: SparkSession, ledger: DataFrame, query: str, limit: int = 30, budget: float = 6.0, read: Read = opened) -> DataFrame:
    """path, size of skipped files (path, size) that hold ``query`` in any case, smallest first; then one row with timed_out, checked and total, if ``budget`` seconds did not do.

    Files are looked at in waves of growing size, each a job that is cancelled when the time is up; what
    the waves before found stays. Unreadable files count as checked; the first 48 MB of a file are searched.
    """
    schema = "path string, size long, timed_out boolean, checked long, total long"
    if not query.strip():
        return spark.createDataFrame([], schema)
    context, needle = spark.sparkContext, query.lower()
    files = ledger.select("path", "size").distinct()
    checked, group = context.accumulator(0), uuid.uuid4().hex
    end, low, found, late = time.monotonic() + budget, -1, [], False

    def matches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def holds(path: str) -> bool:
            checked.add(1)
            try:
                return needle in read(path)[:READ].decode("utf-8", "replace").lower()
            except OSError:
                return False

        for f in frames:
            yield f[f["path"].map(holds).astype(bool)]

    for high in WAVES:
        wave = files.where((F.col("size") > low) & (F.col("size") <= high)).mapInPandas(matches, "path string, size long")
        wave, rows, wrong = wave.orderBy("size", "path").limit(limit - len(found)), [], []

        def look(wave: DataFrame = wave, rows: list = rows, wrong: list = wrong) -> None:
            context.setJobGroup(group, "search of skipped files", interruptOnCancel=True)
            try:
                rows += wave.collect()
            except Exception as e:  # told below, unless it was cancelled
                wrong.append(e)

        if time.monotonic() >= end:
            late = True
            break
        job = InheritableThread(target=look)
        job.start()
        job.join(max(0.0, end - time.monotonic()))
        if job.is_alive():
            late = True
            while job.is_alive():  # a job that was about to begin is cancelled too
                context.cancelJobGroup(group)
                job.join(0.2)
            break
        if wrong:
            raise wrong[0]
        found += [(r.path, r.size, None, None, None) for r in rows]
        low = high
        if len(found) == limit:
            break
    if late:
        found.append((None, None, True, checked.value, files.count()))
    return spark.createDataFrame(found, schema)


def written(hits: DataFrame) -> DataFrame:
    """Hits as lines of text: place, path, line and snippet."""
    place = F.concat_ws(":", "path", F.col("line_no").cast("string"))
    return hits.orderBy("pos").select(F.concat_ws("  ", F.lpad((F.col("pos") + 1).cast("string"), 3, " "), place, F.coalesce("snippet", F.lit(""))).alias("value"))
