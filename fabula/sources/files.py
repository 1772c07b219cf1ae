"""Readers and writers of files: scripts as lines, label logs, reports, exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, DOCX = ("txt", "md"), ("docx",)
LINES = "path string, pos bigint, line string"
_PARAGRAPH, _TEXT_RUN = re.compile(r"<w:p[ >].*?</w:p>", re.DOTALL), re.compile(r"<w:t(?: [^>]*)?>(.*?)</w:t>|<w:(br|cr|tab)\b[^>]*/>", re.DOTALL)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-empty trimmed lines of UTF-8 text files, in order: LINES. Bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(paths)
    rows = files.filter(suffix(F.col("path")).isin(*TEXT)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    lines = rows.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    return lines.select("path", F.col("pos").cast("bigint").alias("pos"), F.trim("line").alias("line")).filter("line <> ''")


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs of a docx file, soft breaks being line ends; trimmed, without empty ones."""
    import html

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    out = []
    for paragraph in _PARAGRAPH.findall(xml):
        text = "".join("\t" if m[2] == "tab" else "\n" if m[2] else html.unescape(m[1] or "") for m in _TEXT_RUN.finditer(paragraph))
        out += [x.strip() for x in text.split("\n") if x.strip()]
    return out


def read_docx_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of docx files: LINES. A file that can't be read has none; ``ingest_summary`` tells of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    out += [(path, i, line) for i, line in enumerate(docx_lines(content))]
                except (KeyError, zipfile.BadZipFile):
                    continue
            yield pd.DataFrame(out, columns=["path", "pos", "line"])

    files = spark.read.format("binaryFile").load(paths).filter(suffix(F.col("path")).isin(*DOCX))
    return files.select("path", "content").mapInPandas(run, LINES)


def read_script_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of all supported files, each by its reader."""
    return read_text_lines(spark, paths).unionByName(read_docx_lines(spark, paths))


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files with size and whether they are supported, without reading their contents."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return files.withColumn("status", F.when(suffix(F.col("path")).isin(*TEXT, *DOCX), "supported").otherwise("skipped"))


def ingest_summary(files: DataFrame, lines: DataFrame) -> DataFrame:
    """How many files were read, skipped or turned out empty."""
    counts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("status") != "supported", F.col("status")).when(F.coalesce("n", F.lit(0)) > 0, "ingested").otherwise("empty")
    return files.join(counts, "path", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))


#: Reports of whole data sets, which lie among scripts but are none (fixed values), and scenes that a script has at least.
GUARDED = r"/完整本_[^/]*\.[mM][dD]$"
LEAST_SCENES = 3


def ingested(listed: DataFrame, scenes: DataFrame, limit: int | None = None, least: int = LEAST_SCENES) -> DataFrame:
    """``path, status, scenes`` of a folder's files (as ``listing`` gives them) with their numbers of scenes (path, scenes).

    A file is ``guarded`` if it is a report of a data set, ``skipped`` if its format isn't supported, ``empty`` without a scene,
    ``short`` with fewer than ``least``, and else ``ingested``. Files are taken in order of their paths, and after the
    ``limit``-th that is ingested the others aren't reached: they have no row. Only that one path goes through the driver."""
    n = F.coalesce("scenes", F.lit(0))
    status = (
        F.when(F.col("path").rlike(GUARDED), "guarded")
        .when(F.col("status") != "supported", "skipped")
        .when(n == 0, "empty")
        .when(n < least, "short")
        .otherwise("ingested")
    )
    rows = listed.select("path", "status").join(scenes, "path", "left").select("path", status.alias("status"), n.cast("bigint").alias("scenes"))
    if not limit:
        return rows
    taken = rows.filter("status = 'ingested'").orderBy("path").limit(limit).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("last")).first()
    return rows.filter(F.col("path") <= taken["last"]) if taken["n"] == limit else rows


def first_parse(*parsed: DataFrame) -> DataFrame:
    """Lines of the first parser, in order, that gave any for a path."""
    out = parsed[0]
    for more in parsed[1:]:
        out = out.unionByName(more.join(out.select("path").distinct(), "path", "left_anti"))
    return out


def append_labels(labels: DataFrame, folder: str) -> None:
    """Raw labels (dim, target_id, run, value) as JSON lines by dimension; done work is what is there."""
    labels.write.mode("append").partitionBy("dim").json(folder)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("target_id string, run int, value string, dim string").json(folder)


def read_reports(spark: SparkSession, folder: str, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stability reports (dim, verdict, …) of a folder of JSON files, and the wanted dimensions that none of them has."""
    reports = spark.read.option("multiLine", True).json(folder)
    return reports, dims.join(reports.select("dim").distinct(), "dim", "left_anti")


def write_versioned(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """A table written as Parquet, replacing only the partitions that it has."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)


def insert_with_children(parent: DataFrame, children: DataFrame, folder: str, key: str, batch: str = "0") -> None:
    """A batch of parents and their rows, the children first, so a parent that is there has all of them; its counts come from
    them. A batch written again replaces itself."""
    children.write.mode("overwrite").parquet(f"{folder}/children/batch={batch}")
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"))
    parent.join(n, key, "left").fillna(0, subset=["n_children"]).write.mode("overwrite").parquet(f"{folder}/parents/batch={batch}")


def yaml_items(text: Column) -> Column:
    """The items of the first list in a flat YAML text as maps of strings; quotes and comments are taken off."""
    items = F.slice(F.split(text, r"(?m)^\s*-\s+"), F.lit(2), F.size(F.split(text, r"(?m)^\s*-\s+")))
    plain = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s#.*$", "")), "^[\"']|[\"']$", "")
    entry = lambda line: F.struct(F.trim(F.substring_index(line, ":", 1)).alias("key"), plain(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"))
    return F.transform(items, lambda x: F.map_from_entries(F.transform(F.filter(F.split(x, "\n"), lambda line: line.contains(":")), entry)))


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """Few rows as one text, a table of Markdown in the given order."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(listed, lambda x: x["_line"]), "\n")).alias("report"))


def write_json_reports(rows: DataFrame, folder: str, by: str) -> None:
    """Rows as JSON, a folder for each value of ``by``; a report written again replaces itself."""
    rows.withColumn("_by", F.col(by)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_by").json(folder)


def export_text(scenes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each script's scenes as one text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return scenes.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def virtual_paths(scenes: DataFrame, script: str = "script", episode: str = "episode_no", scene: str = "scene_no") -> DataFrame:
    """Scenes with the path of a file each would be."""
    number = F.lpad(F.coalesce(F.col(episode).cast("string"), F.lit("0")), 3, "0")
    return scenes.withColumn("path", F.concat(F.lit("/"), F.col(script), F.lit("/ep"), number, F.lit("/"), F.col(scene), F.lit(".txt")))
