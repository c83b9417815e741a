"""Writers: exports, publishing a next state, batched sending."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.session import scratch_path
from weftline.sources.files import path_exists

# Tasks get these functions by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: first characters that make a spreadsheet run a cell.
FORMULA_START = r"^[=+\-@\t\r]"


def neutralise(column: Column) -> Column:
    """Make a text cell inert that a spreadsheet would run as a formula."""
    return F.when(column.rlike(FORMULA_START), F.concat(F.lit("'"), column)).otherwise(column)


def neutral(df: DataFrame) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: neutralise(F.col(n)) for n in texts}) if texts else df


def _marked_header(df: DataFrame, byte_order_mark: bool) -> DataFrame:
    """A byte-order mark opens each file when its header's first name carries it."""
    return df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if byte_order_mark else df


def export_csv(
    df: DataFrame, path: str, header: bool = True, separator: str = ",", quote: str = '"', byte_order_mark: bool = False
) -> None:
    """Whole set as CSV part files; text cells made inert, quotes doubled, an empty text kept apart from NULL."""
    if byte_order_mark and not header:
        raise Refused("a byte-order mark needs a header")
    (
        _marked_header(neutral(df), byte_order_mark)
        .write.option("header", header)
        .option("sep", separator)
        .option("quote", quote)
        .option("escape", quote)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", quote * 2)
        .csv(path)
    )


def export_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def export_xml(df: DataFrame, path: str, row_element: str = "row", root: str = "rows") -> None:
    df.write.format("xml").option("rowTag", row_element).option("rootTag", root).save(path)


def export_fixed_width(df: DataFrame, path: str, widths: Sequence[tuple[str, int]]) -> None:
    """Fixed-width lines. A value longer than its field fails the job instead of being cut."""
    cells = [
        F.when(F.length(F.col(n).cast("string")) > w, F.raise_error(F.lit(f"value of {n} exceeds {w}")))
        .otherwise(F.rpad(F.coalesce(F.col(n).cast("string"), F.lit("")), w, " "))
        for n, w in widths
    ]
    df.select(F.concat(*cells).alias("value")).write.text(path)


def publish(state: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Put a table's next state in place of the old one; answers its number of rows.

    The state is written whole to a new path first, so a failed job leaves the old table as it
    was, and a table may be computed from itself. Only then are the folders swapped.
    """
    spark = state.sparkSession
    fresh = f"{path.rstrip('/')}.next-{scratch_path(spark, 'x').rsplit('-', 1)[1]}"
    seen = Observation()
    state.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by).parquet(fresh)
    _swap(spark, fresh, path.rstrip("/"))
    return seen.get["rows"]


def _swap(spark: SparkSession, fresh: str, live: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(live).getFileSystem(spark._jsc.hadoopConfiguration())
    previous = f"{live}.previous-{fresh.rsplit('-', 1)[1]}"
    existed = path_exists(spark, live)
    if existed and not system.rename(hadoop(live), hadoop(previous)):
        raise OSError(f"cannot move {live} aside")
    if not system.rename(hadoop(fresh), hadoop(live)):
        if existed:
            system.rename(hadoop(previous), hadoop(live))
        raise OSError(f"cannot publish {live}")
    if existed:
        system.delete(hadoop(previous), True)
    spark.catalog.refreshByPath(live)


def send_in_batches(
    df: DataFrame, order: Sequence[str], batch: int, send: Callable[[int, int, list[dict]], None], streams: int = 1
) -> DataFrame:
    """Send rows in order, ``batch`` at a time; answers one receipt per batch.

    By default the whole insert is one ordered stream: after the first failure nothing more is sent. With several
    ``streams``, each a range of ``order`` and a task, a failure stops its own stream only; ask for them
    where the sink takes parts independently. ``send`` gets stream, batch number and rows; the two
    numbers make a resend after a lost executor recognisable. Run it by one write only.
    """
    if batch <= 0:
        raise Refused("batch size must be positive")
    if streams <= 0:
        raise Refused("there must be a stream")
    ranged = df.repartitionByRange(streams, *order)
    fields = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = TaskContext.get().partitionId()
        waiting: list[dict] = []
        number, failed = 0, False

        def deliver(rows: list[dict]) -> pa.RecordBatch:
            nonlocal failed
            error = None
            try:
                send(stream, number, rows)
            except Exception as problem:  # noqa: BLE001 - any failure of the sink ends the stream
                failed, error = True, str(problem)
            return pa.RecordBatch.from_pylist(
                [{"stream": stream, "batch": number, "rows": 0 if failed else len(rows), "error": error}],
                schema=pa.schema([("stream", pa.int32()), ("batch", pa.int32()), ("rows", pa.int64()), ("error", pa.string())]),
            )

        for piece in batches:
            if failed:
                continue
            waiting.extend(piece.select(fields).to_pylist())
            while len(waiting) >= batch and not failed:
                head, waiting = waiting[:batch], waiting[batch:]
                yield deliver(head)
                number += 1
        if waiting and not failed:
            yield deliver(waiting)

    return ranged.sortWithinPartitions(*order).mapInArrow(run, "stream int, batch int, rows long, error string")
