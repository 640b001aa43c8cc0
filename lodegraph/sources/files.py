"""Files as rows: scans, routing by path, archives."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that hold no sources of their own.
EXCLUDED = (".git", "node_modules", "build", "dist", "target", "__pycache__", ".venv", "vendor")


def scan(spark: SparkSession, root: str, pattern: str = "*", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """path, modified, size, content of all files under root by a name pattern, but those below an excluded directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where(outside(F.col("path"), excluded)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def outside(path: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    return ~F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*(F.lit(x) for x in excluded)))


def route(path: Column) -> Column:
    """What reads a file: build, trio, source, html, markdown, zip or none."""
    name = F.element_at(F.split(F.lower(path), r"[\\/]"), -1)
    return (
        F.when(name.isin("build.fan", "package.json", "pyproject.toml", "cargo.toml", "go.mod"), "build")
        .when(name.endswith(".trio"), "trio")
        .when(name.rlike(r"\.(fan|axon|js|mjs|jsx|ts|tsx|py|go|rs|java|vue|css)$"), "source")
        .when(name.rlike(r"\.html?$"), "html")
        .when(name.endswith(".md"), "markdown")
        .when(name.endswith(".zip"), "zip")
        .otherwise("none")
    )


def unzipped(files: DataFrame) -> DataFrame:
    """path, entry, text of every text entry of zip files (path, content); bytes that are no UTF-8 are replaced."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, e.filename, z.read(e).decode("utf-8", "replace")) for e in z.infolist() if not e.is_dir()]
            yield pd.DataFrame(rows, columns=["path", "entry", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, text string")
