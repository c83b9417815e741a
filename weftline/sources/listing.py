"""Document listings and path addresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import Refused

# Fixed value: documents per listing page.
PAGE_SIZE = 200


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path below ``root``, size and modification time of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/"))
    return files.select(
        F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), "length", F.col("modificationTime").alias("modified")
    )


def document_listing(
    documents: DataFrame, path: str, folder: str = "", recursive: bool = True, after: str | None = None, size: int = PAGE_SIZE
) -> DataFrame:
    """One page of the documents below a folder in ordinal path order, with the continuation.

    ``continuation`` is the page's last path when more follow, NULL otherwise.
    """
    if size <= 0:
        raise Refused("page size must be positive")
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    below = documents.where(F.col(path).startswith(prefix)) if prefix else documents
    if not recursive:
        below = below.where(~F.substring(F.col(path), len(prefix) + 1, 2**31 - 1).contains("/"))
    rest = below if after is None else below.where(F.col(path) > F.lit(after))
    fetched = rest.orderBy(path).limit(size + 1)
    # The page is bounded by its size: folding it into one row costs one small group.
    bounds = fetched.agg(F.sort_array(F.collect_list(path)).alias("p"))
    last = F.when(F.size("p") > size, F.get("p", F.lit(size - 1)))
    listed = fetched.withColumn("continuation", bounds.select(last).scalar())
    return listed.where(F.col("continuation").isNull() | (F.col(path) <= F.col("continuation")))


_PART = re.compile(r"\{(\w+)\}")


def template_pattern(template: str) -> tuple[str, list[str]]:
    """A path template as a pattern; each ``{name}`` is one path segment or part of one."""
    names = _PART.findall(template)
    if not names or len(set(names)) != len(names):
        raise Refused("a path template needs distinct named parts")
    pieces = _PART.split(template)
    body = "".join("([^/]+)" if i % 2 else re.escape(p) for i, p in enumerate(pieces))
    return f"^{body}$", names


def read_address(df: DataFrame, path: str, template: str) -> DataFrame:
    """The named parts of each path; rows the template does not fit are left out."""
    pattern, names = template_pattern(template)
    fitting = df.where(F.col(path).rlike(pattern))
    return fitting.withColumns({n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(names)})


def build_address(df: DataFrame, template: str, name: str, **injected: object) -> DataFrame:
    """The path of each row; parts come from columns, or from injected values such as the tenant."""
    _, parts = template_pattern(template)
    pieces = []
    for i, piece in enumerate(_PART.split(template)):
        if i % 2:
            pieces.append(F.lit(injected[piece]).cast("string") if piece in injected else F.col(piece).cast("string"))
        elif piece:
            pieces.append(F.lit(piece))
    return df.withColumn(name, F.concat(*pieces))
