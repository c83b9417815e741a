"""Page bodies, one text per row, to records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The members that wrap the records of a page, in order of preference.
WRAPPERS = ("data", "results", "items", "value")


def unwrap_envelope(pages: DataFrame, body: str, record: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One row per record of each page; the wrapped array, or the body itself.

    A body that is no JSON comes through as one row with the text in ``raw_body``. Bodies are
    parsed once with the declared record schema, on the JVM.
    """
    many = T.ArrayType(record)
    envelope = T.StructType([T.StructField(w, many) for w in WRAPPERS])
    readable = F.expr(f"try_parse_json(`{body}`)").isNotNull()
    wrapped = F.from_json(F.col(body), envelope)
    bare = F.from_json(F.col(body), many)
    parsed = pages.select(
        *keep,
        F.when(~readable, F.col(body)).alias("raw_body"),
        F.when(readable, F.coalesce(*[wrapped[w] for w in WRAPPERS], bare)).alias("__records"),
    )
    records = parsed.select(*keep, "raw_body", F.explode_outer("__records").alias("__r"))
    # An empty page yields nothing; an unreadable body yields its text.
    kept = records.where(F.col("__r").isNotNull() | F.col("raw_body").isNotNull())
    return kept.select(*keep, *[F.col(f"__r.{f}").alias(f) for f in record.names], "raw_body")


def page_metadata(pages: DataFrame, body: str) -> DataFrame:
    """Total count and next link of each page."""
    text = F.col(body)
    return pages.withColumns(
        {
            "total": F.get_json_object(text, "$.meta.total").try_cast("long"),
            "next": F.get_json_object(text, "$.links.next"),
        }
    )


def _below_body(rest: str) -> str:
    return "/*[local-name()='Envelope']/*[local-name()='Body']/*[1]" + rest


def _xpath(body: str, expression: str) -> Column:
    return F.xpath_string(F.col(body), F.lit(expression))


def unwrap_soap(messages: DataFrame, body: str, fields: Sequence[str]) -> DataFrame:
    """The first element below the body of each message; a fault is a failed row with its text."""
    element = _xpath(body, f"local-name({_below_body('')})")
    failed = element == "Fault"
    fault = _xpath(body, _below_body("/*[local-name()='faultstring']"))
    return messages.withColumns(
        {"element": element, "failed": failed, "fault": F.when(failed, fault)}
        | {n: F.when(~failed, _xpath(body, _below_body(f"/*[local-name()='{n}']"))) for n in fields}
    )
