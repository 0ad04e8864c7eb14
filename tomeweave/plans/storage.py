"""Files written under the shared checkpoint folder and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.payload import raw_text
from ..session import checkpoint_folder
from ..sources import lists, stores
from .base import Catalog, Tables
from .derive import book_isbn13, source_of, sql_isbn13, sql_source

catalog = Catalog()


def _fresh(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@catalog.query(r"""SELECT doc_id, 2 AS cells, length(x) AS n_chars, md5(x) AS digest
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS x FROM documents)""")
def list_cells(t: Tables):
    """Whole texts as quoted cells of list files: line ends, doubled quotes and delimiters inside them come back."""
    path = _fresh(t, "lists")
    line = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('",'), F.col("doc_id").cast("string"))
    t.documents.select(line.alias("value")).write.text(path)
    records = lists.join_quoted_lines(lists.read_lines(t.spark, path), ",").where("value <> '' AND NOT open_quote")
    cells = records.select(lists.cells_of(F.col("value"), ",").alias("cells"))
    return cells.select(F.col("cells")[1].cast("bigint").alias("doc_id"), F.size("cells").alias("cells"), F.length(F.col("cells")[0]).alias("n_chars"), F.md5(F.col("cells")[0]).alias("digest"))


@catalog.query(f"""SELECT {sql_source("doc_id")} AS source, {sql_isbn13("doc_id")} AS isbn13, doc_id, md5(coalesce(text, '')) AS digest FROM documents""")
def metadata_arrays(t: Tables):
    """Whole texts inside records of JSON arrays, each array read by as many tasks as its size asks for."""
    path = _fresh(t, "arrays")
    record = F.to_json(F.struct(book_isbn13("doc_id").alias("isbn13"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    stores.write_metadata_arrays(t.documents.select(source_of(F.col("doc_id")).alias("source"), F.col("doc_id").alias("pos"), record.alias("record")), path)
    rows = stores.read_metadata_arrays(t.spark, path, r"source=([^/]+)/")
    body = F.col("record")
    return rows.select("source", "isbn13", raw_text(body, "doc_id").cast("bigint").alias("doc_id"), F.md5(raw_text(body, "text")).alias("digest"))


@catalog.query(f"""SELECT DISTINCT {sql_source("p_partkey")} AS source, CASE WHEN p_size % 2 = 0 THEN 'no_data' ELSE 'incomplete' END AS kind, {sql_isbn13("p_partkey")} AS isbn13 FROM part""")
def ledger_files(t: Tables):
    """Ledgers written as sorted text per kind and source, and read as sets."""
    path = _fresh(t, "ledgers")
    kind = F.when(F.col("p_size") % 2 == 0, F.lit("no_data")).otherwise(F.lit("incomplete"))
    stores.write_ledgers(t.part.select(source_of(F.col("p_partkey")).alias("source"), kind.alias("kind"), book_isbn13("p_partkey").alias("isbn13")), path)
    return stores.read_written_ledgers(t.spark, path)


@catalog.query(f"""SELECT {sql_isbn13("p_partkey")} AS isbn13, p_brand AS origin, count(*) OVER (PARTITION BY p_brand) AS books FROM part""")
def report_files(t: Tables):
    """The origin side file and a report table, written and joined again."""
    path = _fresh(t, "report")
    sidecar = t.part.select(book_isbn13("p_partkey").alias("isbn13"), F.col("p_brand").alias("origin"))
    stores.write_sidecar(sidecar, f"{path}/origins")
    stores.write_report({"origins": sidecar.groupBy("origin").agg(F.count(F.lit(1)).alias("books"))}, f"{path}/report")
    origins = t.spark.read.schema("isbn13 string, origin string").json(f"{path}/origins")
    return origins.join(t.spark.read.parquet(f"{path}/report/origins"), "origin").select("isbn13", "origin", "books")
