"""Discovery and reading of CSV files in folders, zip archives and zips within zips."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

COLUMNS = "file_path string, filename string, source_type string, year string, month string, exchange string, symbol string, file_size bigint, container_path string, csv_path_in_archive string, nested_archive string, file_hash string, raw_text string, error string"


def place(path: str) -> dict[str, str | None]:
    """Year, month, exchange and symbol that a path names, where it does."""
    year = re.search(r"(\d{4})年", path)
    month = re.search(r"(?:^|[/:])(\d{2})(?:\.zip)?[/:]", path.split("年", 1)[-1]) if year else None
    name = re.search(r"(?:(SH|SZ|BJ)\.(\d{6})|(\d{6})\.(SH|SZ|BJ))\.csv$", path)
    return {"year": year and year[1], "month": month and month[1], "exchange": name and (name[1] or name[4]), "symbol": name and (name[2] or name[3])}


def decode(data: bytes) -> str:
    """Text of a file: UTF-8, else GB18030."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", errors="replace")


def _members(path: str, data: bytes, depth: int) -> Iterator[dict]:
    """A row per CSV of a file; archives are opened to any depth up to `depth`, and what can't be read is a row with its error."""

    def row(full: str, body: bytes | None, container: str | None, inner: str | None, nested: str | None, error: str | None = None) -> dict:
        name = full.rpartition("/")[2].rpartition(":")[2]
        out = {"file_path": full, "filename": name, "source_type": "zip" if container else "directory", **place(full), "container_path": container, "csv_path_in_archive": inner, "nested_archive": nested, "error": error}
        return out | {"file_size": None if body is None else len(body), "file_hash": None if body is None else hashlib.md5(body).hexdigest(), "raw_text": None if body is None else decode(body)}

    def open_zip(content: bytes, inside: tuple[str, ...]) -> Iterator[dict]:
        nested = ":".join(inside) or None
        here = ":".join((path, *inside))
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for n in z.namelist():
                    kind = n.lower().rpartition(".")[2]
                    if kind not in ("csv", "zip"):
                        continue
                    try:
                        body = z.read(n)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
                        yield row(f"{here}:{n}", None, path, n, nested, f"{type(e).__name__}: {e}")
                        continue
                    if kind == "csv":
                        yield row(f"{here}:{n}", body, path, n, nested)
                    elif len(inside) >= depth:
                        yield row(f"{here}:{n}", None, path, n, nested, "nested too deep")
                    else:
                        yield from open_zip(body, (*inside, n))
        except zipfile.BadZipFile as e:
            yield row(here, None, path, None, nested, f"BadZipFile: {e}")

    if path.lower().endswith(".csv"):
        yield row(path, data, None, None, None)
    else:
        yield from open_zip(data, ())


def discover_csv(spark: SparkSession, folder: str, partitions: int | None = None, depth: int = 5, known: DataFrame | None = None) -> DataFrame:
    """One row per CSV file under a folder, archives opened (zips in zips up to `depth`), with its text and hash.

    Endings count in any case. Containers are spread over tasks as whole files and unpacked
    member by member, so a task holds one container's compressed bytes and one member. An
    archive or member that can't be read gives a row with its path and `error`, no text.
    `known` (file_hash) are files already processed: their rows are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[cC][sS][vV],[zZ][iI][pP]}").load(folder).select("path", "content")
    if partitions:
        files = files.repartition(partitions)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                part, held = [], 0
                for r in _members(path.removeprefix("file:"), bytes(content), depth):
                    part.append(r)
                    held += r["file_size"] or 0
                    if held > 32 << 20:
                        yield pd.DataFrame(part, columns=names)
                        part, held = [], 0
                if part:
                    yield pd.DataFrame(part, columns=names)

    found = files.mapInPandas(read, COLUMNS)
    return found if known is None else found.join(known.select("file_hash").distinct(), "file_hash", "left_anti").select(*names)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's ending: csv, json, parquet, orc, feather (Arrow file)."""
    kind = path.rpartition(".")[2].lower()
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if kind in ("json", "parquet", "orc"):
        return getattr(spark.read, kind)(path)
    if kind in ("feather", "arrow"):
        return _read_arrow(spark, path)
    raise ValueError(f"no reader for .{kind}")


def _read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow files (one, or those of a folder) read by the tasks; the driver reads one file's schema only."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").limit(1).collect()
    if not first:
        raise ValueError(f"no file at {path}")
    with pa.ipc.open_file(first[0][0]) as f:
        schema = from_arrow_schema(f.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                with pa.ipc.open_file(content.as_buffer()) as f:
                    for i in range(f.num_record_batches):
                        yield f.get_batch(i)

    return files.select("content").mapInArrow(read, schema)
