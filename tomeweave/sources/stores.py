"""Stored metadata, ledgers, artefacts and pages: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import json_arrays
from ..functions.core import compute_once
from ..functions.markup import looks_like_html
from ..functions.payload import elements, is_object, raw_text
from ..session import checkpoint_folder


_IN_STRING = r'(?:[^"\\]++|\\.)*+'
_SPLIT = ["file", "_block"]


def _same_splits(df: DataFrame) -> DataFrame:
    """The same rows, cut into tasks once: every job over them sees the same splits of the files."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as pieces up to its closing braces, each with what it says about strings, brackets and commas.

    The brace is the record separator of the scan, so one long line is many tasks as well.  A task
    has the pieces of a split ``(file, _block)`` one after the other.  ``_from_0`` and ``_from_1`` are the
    states behind a piece that is reached outside (0) and inside (1) of a string, ``_marks_0`` and ``_marks_1`` its
    brackets and commas outside strings, up to a string it leaves open.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = _same_splits(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
                                     F.col("_metadata.file_block_start").alias("_block"), "value"))
    quote = F.lit('"')
    entered = F.regexp_replace("value", f'(?s)^{_IN_STRING}(?:"|$)', "")
    closed = F.col("value").rlike(f'(?s)^{_IN_STRING}"')
    bare = compute_once(pieces, _bare_0=_strip_strings(F.col("value")), _bare_1=F.when(closed, _strip_strings(entered)))
    marks = lambda text: F.regexp_replace(F.substring_index(text, '"', 1), r"[^\[\]{,]+", "")
    return bare.select(*_SPLIT, "_size", "value", F.contains("_bare_0", quote).cast("int").alias("_from_0"),
                       F.coalesce(F.contains("_bare_1", quote), F.lit(True)).cast("int").alias("_from_1"),
                       marks(F.col("_bare_0")).alias("_marks_0"), F.coalesce(marks(F.col("_bare_1")), F.lit("")).alias("_marks_1"))


def read_metadata_arrays(spark: SparkSession, path: str, name: str = r"([^/]*)_metadata\.json$") -> DataFrame:
    """``<source>_metadata.json`` arrays to ``(source, pos, isbn13, record)``; ``name`` finds the source in a file's path.

    A file that does not parse gives no rows, elements that are no objects are dropped (``pos``
    counts them), and a bare object is one record.

    One array of any size is read by many tasks: a file is cut at closing braces; each piece says
    whether it ends inside a string, read from outside and from inside of one, and where its
    brackets lead.  A first pass adds that up for each split of a file, so the second and third
    know the state, depth and element in which a split begins.  A piece that ends one level deep ends
    an element.  Texts are not shuffled or kept but for elements that splits share: the second pass
    tells which files do not parse, the third gives the rows.  No task holds more than the pieces of one element.
    """
    checkpoint_folder(spark)
    # a task and its worker hold some copies of a batch
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    pieces = _chunks(spark, path)
    states = ["_from_0", "_from_1", "_marks_0", "_marks_1"]
    splits = pieces.select(*_SPLIT, "_size", (F.octet_length("value") + 1).alias("_octets"), F.col("value").rlike("^\\s*\\{").alias("_starts"), *states)
    entered = splits.mapInArrow(json_arrays.summaries, json_arrays.SPLIT).groupBy("file").applyInArrow(json_arrays.entries, json_arrays.ENTRY).checkpoint()

    def cut(known: DataFrame) -> DataFrame:
        # a row for each split of a file; joined by another plan the pieces would leave their order
        fed = pieces.join(F.broadcast(known), _SPLIT).select(*_SPLIT, *states, F.col("value").cast("binary").alias("value"), "_entry")
        return fed.mapInArrow(json_arrays.elements, json_arrays.ELEMENT).withColumn("text", F.col("text").cast("string"))

    wrong = lambda df: df["items"].isNull() | (df["_end"] & (df["_depth"] != 0))
    read = _parsed(cut(entered))
    read = read.withColumn("_wrong", F.col("_whole") & wrong(read)).where(~F.col("_whole") | F.col("_wrong")).drop("items").checkpoint()
    parts = F.array_sort(F.collect_list(F.struct("_block", "text")))
    shared = (read.where(~F.col("_whole")).groupBy("file", "_element")
              .agg(F.min("_before").alias("_before"), F.max("_end").alias("_end"), F.max_by("_depth", "_block").alias("_depth"),
                   F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text")))
    joined = _parsed(shared)
    bad = read.where("_wrong").select("file").union(joined.where(wrong(joined)).select("file")).distinct()
    whole = cut(entered.join(bad, "file", "left_anti")).where("_whole").select(shared.columns)
    parsed = _parsed(whole.union(shared.join(bad, "file", "left_anti").select(shared.columns)))
    rows = parsed.select(F.regexp_extract("file", name, 1).alias("source"), "_before", F.posexplode("items").alias("at", "record"))
    rows = rows.where(is_object(F.col("record"))).select("source", (F.col("_before") + F.col("at")).alias("pos"), "record")
    return rows.select("source", "pos", F.trim(raw_text(F.col("record"), "isbn13")).alias("isbn13"), "record")


def _parsed(groups: DataFrame) -> DataFrame:
    """The texts of elements with their ``items``, null where one does not parse."""
    groups = compute_once(groups, _body=F.trim(F.regexp_replace("text", "^[\\s\\x{FEFF}]+|\\s+$", "")))
    # "[a, {..}" and ", b, {..}" and ", c]" become arrays of their own
    first, body = F.col("_element") == 0, F.col("_body")
    lone = first & F.col("_end") & ~F.startswith(body, F.lit("["))
    opened = F.when(first & F.startswith(body, F.lit("[")), F.substr(body, F.lit(2))).when(~first & F.startswith(body, F.lit(",")), F.substr(body, F.lit(2)))
    rest = F.when(F.col("_end"), F.when(F.endswith(body, F.lit("]")), F.regexp_replace(F.coalesce(opened, body), "\\s*\\]$", ""))).otherwise(opened)
    # behind the last element only the end of the array may stand, in front of it no comma alone
    rest = F.when(F.col("_end") & ~first & F.startswith(body, F.lit("]")), F.regexp_replace(body, "^\\]$", "")).otherwise(rest)
    # the parser stops behind a whole value; inside an object anything that follows is an error
    list_text = F.concat(F.lit('{"x":['), F.when(lone, body).otherwise(rest), F.lit("]}"))
    bad_comma = ~first & F.startswith(body, F.lit(",")) & (F.trim(F.coalesce(rest, F.lit(""))) == "")
    return groups.withColumn("items", F.when(~bad_comma, F.try_variant_get(F.try_parse_json(list_text), "$.x", "array<variant>"))).drop("_body")


def _strip_strings(text: Column) -> Column:
    """What stands outside strings, read from outside; a string left open leaves its quote."""
    return F.regexp_replace(F.regexp_replace(text, f'(?s)"{_IN_STRING}"', ""), f'(?s)"{_IN_STRING}\\\\?$', '"')


def record_fields(rows: DataFrame) -> DataFrame:
    """The eight fields of stored records."""
    record = F.col("record")
    plain = ["title", "publisher", "origin", "date_of_publication", "language", "genre"]
    authors = F.transform(elements(record, "authors"), lambda a: raw_text(a))
    return rows.select("source", "isbn13", "pos", authors.alias("authors"), *[raw_text(record, f).alias(f) for f in plain])


def read_ledgers(spark: SparkSession, folder: str) -> DataFrame:
    """``<source>_no_data.txt`` and ``<source>_incomplete.txt`` to ``(source, kind, isbn13)``, as sets."""
    lines = spark.read.text(f"{folder}/*_{{no_data,incomplete}}.txt")
    name = F.regexp_extract("_metadata.file_name", "^(.*)_(no_data|incomplete)\\.txt$", 1)
    kind = F.regexp_extract("_metadata.file_name", "^(.*)_(no_data|incomplete)\\.txt$", 2)
    return (lines.select(name.alias("source"), kind.alias("kind"), F.explode(F.split("value", "\\s+")).alias("isbn13"))
            .where("isbn13 <> ''").distinct())


def read_written_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_ledgers` wrote, as ``(source, kind, isbn13)``."""
    lines = spark.read.schema("value string, kind string, source string").text(path)
    return lines.select("source", "kind", F.col("value").alias("isbn13")).where("isbn13 <> ''").distinct()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their content, for ``artefacts.image_ext``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("length").alias("bytes"), "content")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages; bodies that are no HTML are left out."""
    return spark.read.parquet(path).where(looks_like_html(F.col("html")))


# ------------------------------------------------------------------ sinks
def write_by_source(df: DataFrame, path: str, buckets: int = 64, keep_others: bool = True) -> None:
    """A table partitioned by source; a big source is spread over ``buckets`` write tasks.

    ``keep_others`` replaces only the sources that ``df`` holds.
    """
    spread = df.repartition(F.col("source"), F.pmod(F.xxhash64("isbn13"), F.lit(buckets)))
    how = "dynamic" if keep_others else "static"
    spread.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("source").parquet(path)


def append_records(new: DataFrame, path: str) -> None:
    """Append new versions; ``operators.upsert.latest`` reads the newest of each key.

    The cheap write of a long run.  Compact with :func:`replace_snapshot` now and then.
    """
    new.write.mode("append").partitionBy("source").parquet(path)


def write_metadata_arrays(records: DataFrame, path: str, parts: int = 16) -> None:
    """``(source, pos, record)`` with records as JSON text to array files, ``parts`` of them for each source.

    Every file is one array in the order of ``pos``; ``read_metadata_arrays`` reads it with the
    pattern ``source=([^/]+)/``.  More parts keep a big source's files and write tasks small.
    """
    dealt = records.withColumn("part", F.pmod(F.xxhash64("pos"), F.lit(parts)))
    file = W.partitionBy("source", "part").orderBy("pos")
    start = F.when(F.lag("pos").over(file).isNull(), F.lit("[")).otherwise(F.lit(""))
    end = F.when(F.lead("pos").over(file).isNull(), F.lit("]")).otherwise(F.lit(","))
    lines = dealt.select("source", "part", "pos", F.concat(start, "record", end).alias("value"))
    # the window has put each file's rows into one task, in order
    (lines.sortWithinPartitions("source", "part", "pos").drop("pos")
     .write.partitionBy("source", "part").text(path))


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete snapshots under a root."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    done = []
    for status in files.listStatus(hadoop):
        folder = status.getPath()
        if folder.getName().startswith("snapshot=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            done.append(int(folder.getName().split("=")[1]))
    return sorted(done)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete snapshot; one that broke half-way is never seen."""
    done = snapshots(spark, root)
    return spark.read.parquet(f"{root}/snapshot={done[-1]}") if done else None


def replace_snapshot(df: DataFrame, root: str) -> int:
    """Write the next snapshot; the one that ``df`` was read from stays untouched."""
    done = snapshots(df.sparkSession, root)
    number = done[-1] + 1 if done else 0
    write_by_source(df, f"{root}/snapshot={number}", keep_others=False)
    return number


def write_ledgers(ledgers: DataFrame, path: str) -> None:
    """Sorted ISBNs, one per line, in a folder per kind and source; others stay untouched."""
    rows = ledgers.select("kind", "source", F.col("isbn13").alias("value")).repartitionByRange("kind", "source", "value")
    (rows.sortWithinPartitions("kind", "source", "value").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("kind", "source").text(path))


def write_sidecar(sidecar: DataFrame, path: str) -> None:
    sidecar.orderBy("isbn13").write.mode("overwrite").json(path)


def write_report(tables: dict[str, DataFrame], root: str) -> None:
    """One table per report."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
