"""What a build keeps between runs, and how files get to the vault: every write is renamed into place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import incremental as I
from weftgraph.operators.graph import cut
from weftgraph.sources.extract import Extractors, extract

VERSION = 2


def uri_of(folder: str) -> str:
    return folder if "://" in folder else Path(folder).resolve().as_uri()


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts: Iterator[str]) -> None:
    """One file from pieces of text: written under another name, then moved, so that a reader never sees half of it."""
    system, path = _system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for text in parts:
            out.write(text.encode("utf-8"))
    system.move(part, path)


def read_file(uri: str) -> str | None:
    system, path = _system(uri)
    try:
        with system.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def delete(uri: str) -> None:
    """A file or a folder, if it is there."""
    from pyarrow import fs

    system, path = _system(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def save_table(df: DataFrame, root: str, name: str, key: str = "") -> DataFrame:
    """Replace a table: a new folder, then its pointer, then the old folder goes.  ``key`` says what it is valid for."""
    old = read_file(f"{root}/{name}.json")
    folder = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    write_file(f"{root}/{name}.json", iter([json.dumps({"version": VERSION, "folder": folder, "key": key})]))
    try:
        if old and (gone := json.loads(old).get("folder")):
            delete(f"{root}/{gone}")
    except ValueError:
        pass
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{folder}")


def load_table(spark: SparkSession, root: str, name: str, key: str = "") -> DataFrame | None:
    """The table of :func:`save_table`, or None if it is missing, broken, of another version or for another key."""
    try:
        found = json.loads(read_file(f"{root}/{name}.json") or "{}")
        if found.get("version") != VERSION or found.get("key") != key:
            return None
        return spark.read.parquet(f"{root}/{found['folder']}")
    except (ValueError, KeyError, AttributeError, AnalysisException):
        return None


def parse(spark: SparkSession, files: DataFrame, root: str | None, cache: bool, extractors: Extractors | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(extracted with md5, size, mtime_ns; dirty paths; counts).

    A file is looked at if its time or size differs from the last run's, and parsed if its digest does too; all others keep their rows.
    Without changed files no content is read.
    """
    columns = ["path", "lang", "error", "nodes", "edges", "md5", "size", "mtime_ns"]
    stat = cut(files.select("path", "lang", "size", "mtime_ns"))
    old = load_table(spark, root, "parsed") if root and cache else None
    removed = 0
    if old is None:
        todo = cut(files.select("path", "md5"))
        kept = None
        dirty = todo.select("path")
    else:
        changed = cut(I.dirty_files(stat, old.select("path", "mtime_ns", "size")))
        digest = cut(files.join(changed.where("reason <> 'removed'").select("path"), "path", "left_semi").select("path", "md5"))
        todo = cut(digest.join(old.select("path", "md5"), ["path", "md5"], "left_anti"))
        gone = changed.where("reason = 'removed'").select("path")
        removed = gone.count()
        kept = old.select("path", "error", "nodes", "edges", "md5").join(todo.select("path"), "path", "left_anti").join(stat, "path").select(columns)
        dirty = todo.select("path").unionByName(gone)
    parsed = todo.count()
    if old is not None and not parsed and not removed:
        return old.select(columns), dirty, {"parsed": 0, "reused": kept.count()}
    new = extract(files.join(todo.select("path"), "path", "left_semi"), extractors).join(todo, "path").join(stat.select("path", "size", "mtime_ns"), "path").select(columns)
    rows = new if kept is None else kept.unionByName(new)
    rows = save_table(rows, root, "parsed") if root else cut(rows)
    return rows, dirty, {"parsed": parsed, "reused": stat.count() - parsed}


def written_pages(spark: SparkSession, vault: str, folders: tuple[str, ...]) -> DataFrame:
    """(path) of the pages in the vault, by listing alone."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load([f"{vault}/{d}" for d in folders])
    return read.select(F.regexp_extract("path", "([^/]+/[^/]*)$", 1).alias("path"))


def write_pages(pages: DataFrame, vault: str, gone: DataFrame) -> dict[str, int]:
    """Write pages (path, content) whose content differs from the file's, and delete ``gone``; counts of what was done.

    Each task compares and writes its own pages; a task that runs again finds them equal.
    """

    def act(rows):
        done = {"write": 0, "keep": 0, "delete": 0}
        for r in rows:
            if r.content is None:
                delete(f"{vault}/{r.path}")
                done["delete"] += 1
            elif read_file(f"{vault}/{r.path}") == r.content:
                done["keep"] += 1
            else:
                write_file(f"{vault}/{r.path}", iter([r.content]))
                done["write"] += 1
        yield done

    work = pages.select("path", "content").unionByName(gone.select("path", F.lit(None).cast("string").alias("content")))
    total = {"write": 0, "keep": 0, "delete": 0}
    for part in cut(work).rdd.mapPartitions(act).collect():  # one row of counts per task
        for k, n in part.items():
            total[k] += n
    return total
