"""Readers and writers for corpora, tables, reports and function tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.scale import first_per_key, stable_hash

__all__ = [
    "read_corpus",
    "write_sources",
    "load",
    "read_csv",
    "read_keyed_lines",
    "write_folds",
    "write_report",
    "with_function_id",
    "write_functions",
    "parse_provenance",
    "export_corpus",
]


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.cpp") -> DataFrame:
    """One row per source file below ``root``: index (file stem), label (folders joined by ``$``), problem, code."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    base = F.lit("/" + root.removeprefix("file:").strip("/"))
    label = X.corpus_label(F.col("path"), base)
    return (
        files.select(path.alias("path"), F.col("value").alias("code"))
        .select(
            X.file_stem(F.col("path")).alias("index"),
            label.alias("label"),
            F.split_part(label, F.lit("$"), F.lit(1)).alias("problem"),
            "code",
        )
    )


_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{[\]^]""")


def _folder(name: str, value: str | None) -> str:
    """The folder of a value, named as ``partitionBy`` does."""
    return f"{name}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', value) if value else _NO_VALUE}"


def write_sources(df: DataFrame, root: str, folders: list[str], text: str = "value") -> None:
    """One file ``*.txt`` per row, below a folder per value of ``folders``: the text and a line end.

    Spark's writer starts a process per file, and another for its checksum, to set their rights on a local or mounted file system; there the
    tasks write the files themselves. Rows are in the order of all columns, so a task that runs again writes the same files. Folders of other
    file systems are left to Spark's writer.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in [*folders, text]])
    if urlsplit(root).scheme not in ("", "file"):
        rows.write.option("maxRecordsPerFile", 1).partitionBy(*folders).text(root)
        return
    base = "/" + root.removeprefix("file:").lstrip("/")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in it:
            columns = [c.to_pylist() for c in batch.columns]
            for *values, body in zip(*columns):
                folder = os.path.join(base, *map(_folder, folders, values))
                os.makedirs(folder, exist_ok=True)
                with open(os.path.join(folder, f"part-{part:05d}-{n:09d}.txt"), "wb") as f:
                    f.write((body or "").encode() + b"\n")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(base)
    rows.sortWithinPartitions(*rows.columns).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def load(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """Read csv, tsv, json, jsonl or parquet by file extension with an explicit schema."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        return spark.read.schema(schema).csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')
    if kind == "json":
        return spark.read.schema(schema).json(path, multiLine=multiline)
    if kind == "jsonl":
        return spark.read.schema(schema).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format: {path}")


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Header CSV whose cells all stay text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).csv(path, header=True, sep=sep, escape='"', multiLine=False)


def read_keyed_lines(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Ragged lines: the first cell is the key, the rest a list."""
    return keyed_lines(spark.read.text(path), "value", sep)


def _quoted(sep: str) -> str:
    """The separator as a pattern that matches just itself."""
    return "".join(rf"\Q{c}\E" if c != "\\" else r"\\" for c in sep)


def keyed_lines(df: DataFrame, col: str, sep: str = " ") -> DataFrame:
    cells = F.split(F.col(col), _quoted(sep))
    return df.select(F.get(cells, F.lit(0)).alias("key"), F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))).alias("values"))


def write_folds(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """One directory per fold."""
    df.write.mode(mode).partitionBy("fold").format(fmt).save(path)


def write_report(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """A report with a fixed header; reports hold one row per problem and configuration."""
    df.select(*columns).repartition(1).write.mode(mode).csv(path, header=True)


def with_function_id(df: DataFrame) -> DataFrame:
    """A 63-bit id made from the provenance, the same on every run and every append."""
    h = stable_hash("function", "project", "compiler", "optimization", "file_name", "function_name")
    return df.withColumn("id", F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether something is stored under a path of any file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_functions(df: DataFrame, path: str) -> None:
    """Append functions to a table laid out by compiler and optimisation level, skipping ids already stored and repeated ones."""
    spark = df.sparkSession
    new = with_function_id(df)
    cols = ["id", *[c for c in new.columns if c != "id"]]
    new = first_per_key(new, ["id"], ["compiler", "optimization"])
    if _exists(spark, path):
        places = ["compiler", "optimization"]
        stored = spark.read.parquet(path).select("id", *places)
        # the partition columns in the join let the scan skip the parts that the new rows do not touch
        new = new.join(stored, ["id", *places], "left_anti")
    new.select(*cols).write.mode("append").partitionBy("compiler", "optimization").parquet(path)


def parse_provenance(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Object files with at least four path parts, split into project, compiler, optimisation, file."""
    return (
        df.filter(F.col(path_col).endswith(".o"))
        .withColumn("__p", X.provenance(F.col(path_col)))
        .filter(F.col("__p").isNotNull())
        .select("*", "__p.*")
        .drop("__p")
    )


def export_counts(df: DataFrame, hash_col: str) -> DataFrame:
    """(total, kept): functions read and distinct ones exported."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(hash_col).alias("kept"))


def write_corpus(lines: DataFrame, path: str, mode: str = "error") -> None:
    """The lines of ``export_corpus`` as text files."""
    lines.select("line").write.mode(mode).text(path)


def export_corpus(df: DataFrame, hash_col: str, instr_col: str, order: list[str]) -> DataFrame:
    """First occurrence of every function hash as one line of instructions and five end markers."""
    kept = first_per_key(df.select(hash_col, *order, instr_col), [hash_col], order)
    return kept.select(
        hash_col,
        F.concat(F.lit(" "), F.array_join(F.concat(F.col(instr_col), F.array_repeat(F.lit("endfun"), 5)), " ")).alias("line"),
    )
