"""Files as a source: walking, ignore patterns, metadata and listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.functions.text import language_for_path, path_name, path_parent, path_suffix

# What is indexed and what is passed over.
EXTENSIONS = "py js ts tsx jsx go rs java kt c cpp h hpp rb php swift md txt yaml yml json".split()
SKIPPED_DIRS = "node_modules .git __pycache__ .venv venv myenv env dist build .next .nuxt target .idea .vscode vendor .cache data research_data research_data2".split()
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock composer.lock".split()


def glob_regex(glob: str, any_char: str = ".") -> str:
    """A shell pattern as a regular expression; * and ? match any_char, which includes slashes by default."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner.replace("^", "\\^", 1) if inner[0] == "^" else inner) + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return "".join(out)


def ignore_regex(pattern: str, is_dir: bool = False) -> str | None:
    """One regular expression for a whole relative path (without leading slashes); None for a blank pattern.

    A leading slash anchors; a trailing slash means any directory above a file, or a directory itself; a slash inside
    also matches below any directory; otherwise the name, the whole path, or the path's end is matched. There is no
    negation.
    """
    raw = pattern.strip()
    if not raw:
        return None
    body = glob_regex(raw.strip("/").replace("\\", "/"))
    anchored, inner = raw.startswith("/"), "/" in raw.strip("/")
    if raw.endswith("/"):
        # the path of a directory, or for a plain name its last part, which holds no slash
        start = "" if anchored else "(?:.*/)?"
        part = body if anchored or inner else glob_regex(raw.strip("/"), "[^/]")
        return rf"{start}{part}(?:/.*)?" if is_dir else rf"{start}{part}/.*"
    if anchored:
        return body
    return rf"(?:.*/)?{body}"


def is_ignored(path: Column, patterns: list[str], root: str = "", is_dir: bool = False) -> Column:
    """Whether a path matches any of the patterns; null paths do not."""
    relative = F.regexp_replace(F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "") if root else path, r"^(?:\./)?/*", "")
    out = F.lit(False)
    for p in patterns:
        regex = ignore_regex(p, is_dir)
        if regex:
            out = out | F.rlike(relative, F.lit(f"^(?s:{regex})$"))
    return F.coalesce(out, F.lit(False))


def skipped_directory(path: Column, root: str = "") -> Column:
    """S3: a directory of the path has a name that is passed over, or starts with a dot."""
    relative = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + "/", "") if root else path
    names = F.filter(F.split(path_parent(relative), "/"), lambda d: d != "")
    skipped = F.array(*[F.lit(d) for d in SKIPPED_DIRS])
    return F.exists(names, lambda d: F.array_contains(skipped, d) | F.startswith(d, F.lit(".")))


def is_indexable(path: Column, patterns: list[str] = (), root: str = "") -> Column:
    """A known extension, no lockfile, not in a skipped directory, not ignored."""
    return path_suffix(path).isin(EXTENSIONS) & ~path_name(path).isin(LOCKFILES) & ~skipped_directory(path, root) & ~is_ignored(path, list(patterns), root)


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]


def metadata(path: Column, content: Column, mtime: Column, sampled: bool = False) -> list[Column]:
    """Manifest columns of a file: its size in bytes and a hash of its content.

    ``sampled`` hashes the first 8 KB and the size, for comparison with manifests that hold this form.
    """
    binary = F.encode(content, "utf-8")
    size = F.octet_length(content).cast("bigint")
    return [path.alias("path"), mtime.cast("double").alias("mtime"), size.alias("size"), F.md5(F.concat(F.substring(binary, 1, 8192), F.encode(size.cast("string"), "utf-8")) if sampled else binary).alias("content_hash")]


def read_files(spark: SparkSession, root: str, patterns: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """(file_path, language, size, mtime, content) of the files to index below a folder, or of the given ones that exist.

    Paths are filtered before contents are decoded; bytes that are no UTF-8 are replaced.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        raw = reader.option("recursiveFileLookup", "true").load(root)
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs
        there = [p for p in only if (at := hadoop.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)]
        raw = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    path = F.regexp_replace("path", "^file:/*", "/")
    return (
        raw.withColumn("file_path", path)
        .filter(is_indexable(F.col("file_path"), patterns, root))
        .select("file_path", language_for_path(F.col("file_path")).alias("language"), F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), F.decode("content", "utf-8").alias("content"))
    )


def tree(paths: DataFrame, column: str = "path") -> DataFrame:
    """(dir, name, is_dir, files): the entries of every directory, with the files below each."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = paths.filter(F.col(column).isNotNull()).select(F.col(column).alias("path")).distinct().select(parts.alias("parts"))
    level = rows.select("parts", F.posexplode("parts").alias("depth", "name"))
    return (
        level.select(F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).alias("dir"), "name", (F.col("depth") < F.size("parts") - 1).alias("is_dir"))
        .groupBy("dir", "name", "is_dir")
        .agg(F.count("*").alias("files"))
    )
