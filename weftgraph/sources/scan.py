"""A workspace's source files as a table."""

from __future__ import annotations

import json
import os
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import EXCLUDED, is_excluded, language_of

CONFIG = ".weftgraphrc"


def scan_files(spark: SparkSession, workspace: str, *, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), languages: tuple[str, ...] = (), endings: dict[str, str] | None = None) -> DataFrame:
    """(path, lang, size, mtime_ns, md5, content) of the source files below ``workspace`` that no exclusion names.

    Files are listed and read by the executors; content is pruned from the scan where no one asks for it.  ``endings`` adds file endings
    (with their dot) of registered languages.  A link that leads out of the workspace is not followed.
    """
    root = Path(workspace).resolve()
    roots = [root / i for i in include if (root / i).is_dir()] if include else [root]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    if not roots:
        read, roots = read.option("pathGlobFilter", ""), [root]
    df = read.load([f"file://{r}" for r in roots])
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + str(root).rstrip("/") + "/", "")
    df = df.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")
    lang = language_of(F.col("path"))
    for ending, name in (endings or {}).items():
        lang = F.when(F.endswith(F.lower("path"), F.lit(ending.lower())), name).otherwise(lang)
    for link in _leading_out(root):
        df = df.where(~(F.startswith("path", F.lit(link + "/")) | (F.col("path") == link)))
    df = df.withColumn("lang", lang).where(F.col("lang").isNotNull() & ~is_excluded(F.col("path"), EXCLUDED + exclude))
    df = df.where(F.col("lang").isin(*languages)) if languages else df
    return df.select("path", "lang", "size", "mtime_ns", F.md5("content").alias("md5"), "content")


def _leading_out(root: Path) -> list[str]:
    """Links below ``root`` whose ends lie outside, by a walk over folders that are not excluded."""
    out, skip = [], {n.lower() for n in EXCLUDED}
    for folder, dirs, files in os.walk(root):
        for name in [*dirs, *files]:
            at = Path(folder, name)
            if at.is_symlink() and not at.resolve().is_relative_to(root):
                out.append(str(at.relative_to(root)))
        dirs[:] = [d for d in dirs if d.lower() not in skip]
    return out


def load_config(workspace: str) -> dict:
    """The workspace's settings; empty if there are none, empty with a warning if they cannot be read."""
    path = Path(workspace) / CONFIG
    try:
        found = json.loads(path.read_text("utf-8"))
    except FileNotFoundError:
        return {}
    except (OSError, ValueError) as e:
        warnings.warn(f"{path} is left out: {e}", stacklevel=2)
        return {}
    if not isinstance(found, dict):
        warnings.warn(f"{path} is left out: it holds no object", stacklevel=2)
        return {}
    return found
