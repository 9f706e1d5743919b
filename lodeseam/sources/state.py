"""Small state on disk: JSON documents, feedback logs and result sinks."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.schemas import FEEDBACK


class Folder:
    """A folder on any file system that Spark's Hadoop client reaches: JSON documents, and tables in folders below."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        path = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def load(self, name: str, default):
        """A JSON document; the default where there is none or it cannot be read."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.open(self._at(name))
            try:
                return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return default

    def save(self, name: str, value) -> None:
        """The document is written beside the old one and takes its place in one step."""
        beside = f".{name}-{uuid.uuid4().hex[:8]}"
        stream = self._fs.create(self._at(beside), True)
        stream.write(bytearray(json.dumps(value, indent=2).encode("utf-8")))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context.rename(self._fs.makeQualified(self._at(beside)), self._fs.makeQualified(self._at(name)), options)


def load_json(path: str | Path, default):
    """A user's own JSON document on this machine; the default where there is none or it cannot be read."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default


def save_json(path: str | Path, value) -> None:
    """K10"""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2), encoding="utf-8")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The logged searches; blank and broken lines are passed over."""
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path)


def append_feedback(events: DataFrame, path: str) -> None:
    """K9"""
    events.write.mode("append").json(path)


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(column))


def render(rows: list, limit: int = 10, width: int = 80, preview_lines: int = 3) -> str:
    """Hits as text, grouped by file, previews cut to the width and to a few lines."""
    out: list[str] = []
    last = None
    for r in rows[:limit]:
        if r["file_path"] != last:
            last = r["file_path"]
            out.append(str(last))
        out.append(f"  {r['start_line']}-{r['end_line']}  {r['source']}  {r['score']:.2f}")
        shown = (r["preview"] or "").split("\n")[:preview_lines]
        out.extend("    " + (x if len(x) <= width else x[: width - 3] + "...") for x in shown)
    return "\n".join(out) if out else "No results."
