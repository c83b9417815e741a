"""Files round trip, bodies unwrap, scripts bind, listings continue, sinks send in order."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import Refused
from weftline.session import scratch_path, shared_root
from weftline.sources import envelopes, files, listing, scripts, sinks

PEOPLE = [("10", "Nils; Per", "Umeå"), ("11", 'A "b", C', "Faro"), ("12", "Liv", "Brno")]
SCHEMA = files.declared({"Id": "nvarchar", "Name": "nvarchar", "City": "nvarchar"})


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, SCHEMA)


@pytest.mark.parametrize("separator", [",", ";", "\t"])
@pytest.mark.parametrize("header", [True, False])
def test_delimited_round_trip(spark, people, rows, tmp_path, header, separator):
    path = str(tmp_path / "csv")
    sinks.export_csv(people, path, header=header, separator=separator)
    assert rows(files.read_delimited(spark, path, SCHEMA, header=header, separator=separator)) == PEOPLE


def test_delimited_line_breaks_and_empty_texts(spark, rows, tmp_path):
    path = str(tmp_path / "csv")
    data = [("1", "two\nlines", ""), ("2", None, " padded ")]
    sinks.export_csv(spark.createDataFrame(data, SCHEMA), path)
    assert rows(files.read_delimited_multiline(spark, path, SCHEMA)) == data


def test_export_opens_with_a_byte_order_mark_and_neutral_cells(spark, tmp_path):
    path = tmp_path / "csv"
    sinks.export_csv(spark.createDataFrame([("=1+1", -5)], "a string, b int").coalesce(1), str(path), byte_order_mark=True)
    (part,) = path.glob("part-*.csv")
    assert part.read_bytes().decode("utf-8") == "﻿a,b\n'=1+1,-5\n"


def test_json_round_trip_and_superset(spark, people, rows, tmp_path):
    path = str(tmp_path / "json")
    sinks.export_json(people, path)
    wider = T.StructType([*SCHEMA.fields, T.StructField("Age", T.IntegerType())])
    assert rows(files.read_json(spark, path, wider)) == [(*p, None) for p in PEOPLE]


def test_json_whole_file_array(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"Id": "1"}, {"Id": "2", "Name": "x"}]))
    assert rows(files.read_json(spark, str(tmp_path), SCHEMA, multiline=True)) == [("1", None, None), ("2", "x", None)]


def test_xml_round_trip_cut_to_the_schema(spark, people, rows, tmp_path):
    path = str(tmp_path / "xml")
    sinks.export_xml(people, path, "person", "people")
    assert rows(files.read_xml(spark, path, T.StructType(SCHEMA.fields[:2]), "person")) == [p[:2] for p in PEOPLE]


def test_fixed_width_trims(spark, people, rows, tmp_path):
    path = str(tmp_path / "fixed")
    sinks.export_fixed_width(people, path, [("Id", 4), ("Name", 10), ("City", 6)])
    fields = [files.FixedField("Id", 0, 4, "int"), files.FixedField("Name", 4, 10), files.FixedField("City", 14, 6)]
    assert rows(files.read_fixed_width(spark, path, fields)) == [(int(i), n, c) for i, n, c in PEOPLE]
    with pytest.raises(Exception, match="exceeds"):
        sinks.export_fixed_width(people, str(tmp_path / "short"), [("Name", 3)])


def test_missing_files(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(Refused):
        files.read_or_refuse(spark, path, lambda: files.read_json(spark, path, SCHEMA))
    assert files.read_or_empty(spark, path, SCHEMA, lambda: files.read_json(spark, path, SCHEMA)).count() == 0


def test_partitioned_database_read_needs_bounds(spark):
    with pytest.raises(Refused):
        files.read_database(spark, "jdbc:x", "t", partition_column="id")


RECORD = files.declared({"id": "int", "value": "float"})


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"data": [{"id": 1, "value": 2.5}], "meta": {"total": 100}}', [(1, 2.5, None)]),
        ('{"results": [{"id": 1}], "count": 1}', [(1, None, None)]),
        ('{"items": [{"id": 1}, {"id": 2}]}', [(1, None, None), (2, None, None)]),
        ('{"value": [{"id": 1}], "@odata.count": 1}', [(1, None, None)]),
        ('[{"id": 1, "value": 3}]', [(1, 3.0, None)]),
        ('{"id": 1, "value": 3}', [(1, 3.0, None)]),
        ('{"data": []}', []),
        ("Not JSON", [(None, None, "Not JSON")]),
    ],
)
def test_envelopes(spark, rows, body, want):
    pages = spark.createDataFrame([(body,)], "body string")
    assert rows(envelopes.unwrap_envelope(pages, "body", RECORD)) == want


def test_page_metadata(spark):
    body = '{"data":[],"links":{"next":"/users?page[number]=3"},"meta":{"total":100}}'
    got = envelopes.page_metadata(spark.createDataFrame([(body,), ("[]",)], "body string"), "body").collect()
    assert [(r["total"], r["next"]) for r in got] == [(100, "/users?page[number]=3"), (None, None)]


def test_soap_fault_is_a_failed_row(spark):
    wrap = '<soap:Envelope xmlns:soap="u"><soap:Header/><soap:Body>{}</soap:Body></soap:Envelope>'
    good = wrap.format('<m:Get xmlns:m="v"><m:Name>A &amp; B</m:Name></m:Get>')
    bad = wrap.format("<soap:Fault><faultstring>broken</faultstring></soap:Fault>")
    df = spark.createDataFrame([(good,), (bad,)], "body string")
    got = [tuple(r) for r in envelopes.unwrap_soap(df, "body", ["Name"]).drop("body").collect()]
    assert got == [("Get", False, None, "A & B"), ("Fault", True, "broken", None)]


def test_script_values_are_values_and_take_is_a_guard(spark, people):
    text = "SELECT * FROM {people} WHERE Name = :name OR :name = 'all'"
    hostile = scripts.script_read(spark, text, {"name": "x' OR '1'='1"}, {"people": people})
    assert hostile.count() == 0
    assert scripts.script_read(spark, text, {"name": "all"}, {"people": people}, take=3).count() == 3
    with pytest.raises(Refused):
        scripts.script_read(spark, text, {"name": "all"}, {"people": people}, take=2)


def test_listing_pages_meet(spark, tmp_path):
    for name in ("b/2.txt", "a.txt", "b/1.txt", "b/c/3.txt"):
        target = tmp_path / "root" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(name)
    found = listing.list_files(spark, str(tmp_path / "root"))
    seen, after = [], None
    while True:
        page = listing.document_listing(found, "path", after=after, size=3).orderBy("path").collect()
        seen += [r["path"] for r in page]
        after = page[-1]["continuation"]
        if after is None:
            break
    assert seen == ["a.txt", "b/1.txt", "b/2.txt", "b/c/3.txt"]
    flat = listing.document_listing(found, "path", folder="b", recursive=False)
    assert sorted(r["path"] for r in flat.collect()) == ["b/1.txt", "b/2.txt"]


def test_path_template(spark):
    df = spark.createDataFrame([("t1/demo/a.csv",), ("t1/demo/deep/a.csv",)], "path string")
    got = listing.read_address(df, "path", "{tenantId}/{projectName}/{filename}").collect()
    assert [(r["tenantId"], r["projectName"], r["filename"]) for r in got] == [("t1", "demo", "a.csv")]
    with pytest.raises(Refused):
        listing.template_pattern("plain")


def test_batches_are_sent_in_order_until_the_first_failure(spark, tmp_path):
    out = str(tmp_path)
    df = spark.range(10).select(F.col("id"))

    def send(stream, number, rows):
        if number == 2:
            raise OSError("refused")
        with open(f"{out}/{stream}-{number}", "w") as f:
            f.write(",".join(str(r["id"]) for r in rows))

    receipts = sorted(tuple(r) for r in sinks.send_in_batches(df, ["id"], 3, send, streams=1).collect())
    assert receipts == [(0, 0, 3, None), (0, 1, 3, None), (0, 2, 0, "refused")]
    assert [(tmp_path / f"0-{n}").read_text() for n in (0, 1)] == ["0,1,2", "3,4,5"]


def test_scratch_lies_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_root(spark) + "/weftline/x-")
