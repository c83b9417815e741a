"""Search through the posting table: the rows of a scan, read from few files."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators import grams, search, trigrams

WORDS = ["alpha", "Beta", "gamma ray", "ΑΣ Β", "ΟΔΟΣ", "straße", "İstanbul", "line\nbreak", "a", "ab", "", "100%", "x_y", "日本語テキスト", "😀😃😄"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 5))), rnd.choice([None, "Beta", "delta"]), i * 2) for i in range(600)]
    rows += [(None, "nameless alpha", "beta", 0), (None, None, None, 1), (7, "shares a key: omega", None, 2)]
    return spark.createDataFrame(rows, "id long, t string, u string, n long").repartition(4)


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    return trigrams.build_index(texts, "id", str(tmp_path_factory.mktemp("index") / "i"), parts=16)


TERMS = ["alpha", "ALPHA be", "gamma ray", "ας β", "Σ Β", "ΟΔΟΣ", "οδος", "STRASSE", "straße", "istanbul", "İST", "e\nb", "ab", "a", "0%", "x_y", "本語テ", "😃😄", "omega", "nameless", "nowhere at all", "beta beta beta"]


@pytest.mark.parametrize("term", TERMS)
def test_the_index_finds_what_the_scan_finds(spark, texts, index, rows, term):
    for exact in (False, True):
        found = trigrams.find_text(spark, index, term, exact)
        expected = search.find_text(texts, term, ["t", "u"], exact)
        assert found.columns == expected.columns
        assert rows(found) == rows(expected)


@pytest.mark.parametrize("term", ["beta", "Alpha", "delta", "zz"])
def test_ranked_search_finds_what_the_scan_finds(spark, texts, index, term):
    found = trigrams.ranked_search(spark, index, term, "t")
    expected = search.ranked_search(texts, term, ["t", "u"], "t", "id")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in expected.collect()]


def test_random_terms_find_what_the_scan_finds(spark, texts, index, monkeypatch, rows):
    rnd = random.Random(5)
    held = [r["t"] for r in texts.where("length(t) > 8").collect()]
    # With so few keys pushed to the scan, most searches join.
    for pushed in (1000, 2):
        monkeypatch.setattr(trigrams, "PUSHED", pushed)
        for _ in range(6):
            text = rnd.choice(held)
            at = rnd.randrange(len(text) - 4)
            term = text[at : at + rnd.randint(3, 8)]
            if term.strip():
                assert rows(trigrams.find_text(spark, index, term)) == rows(search.find_text(texts, term, ["t", "u"]))


def scan_of(df):
    """The scan's filters on partitions and on rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", plan).groups()


def test_only_candidate_rows_are_read(spark, texts, index):
    rows = trigrams.candidate_rows(spark, index, "omega")
    parts, pushed = scan_of(rows)
    # The part of the one key found, and that of rows without a key.
    assert 1 <= len(set(re.findall(r"\b\d+\b", parts.replace("#", "_")))) <= 2
    assert "id,7" in pushed.replace(" ", "") or "In(id" in pushed
    assert rows.count() == 2 + texts.where("id = 7").count()
    parts, pushed = scan_of(trigrams._postings_of(spark, index, ["ome", "meg"]))
    assert "gram_part" in parts and "ome" in pushed


def test_a_trigram_that_all_rows_hold_fills_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id"), F.lit("the").alias("t"))
        index = trigrams.build_index(df, "id", str(tmp_path / "i"), parts=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.postings(spark).inputFiles()) > 4
    assert trigrams.find_text(spark, index, "THE", max_results=5).count() == 5


def test_postings_are_the_distinct_trigrams_of_each_row(spark, texts, index, monkeypatch):
    want = sorted(
        (repr(r["id"]), g)
        for r in texts.select("id", F.lower("t").alias("t"), F.lower("u").alias("u")).collect()
        for g in {x[i : i + 3] for x in (r["t"], r["u"]) if x for i in range(len(x) - 2)}
    )
    assert sorted((repr(r["key"]), r["gram"]) for r in index.postings(spark).collect()) == want
    # Lists of keys, not a row for each posting, are dealt and laid out; a task looks at a bounded piece of its texts.
    lists = spark.read.parquet(f"{index.path}/postings")
    assert lists.count() < len(want) / 5 and lists.agg(F.max(F.size("keys"))).first()[0] <= grams.LISTED
    monkeypatch.setattr(grams, "PIECE", 100)
    monkeypatch.setattr(grams, "LISTED", 2)
    again = [x for b in texts.toArrow().select(["id", "t", "u"]).to_batches() for x in grams._lists(iter([b]))]
    assert len(again) > 20 and max(len(k) for b in again for k in b.column("keys").to_pylist()) == 2


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "date", "timestamp", "timestamp_ntz", "double"])
def test_keys_of_many_types(spark, tmp_path, kind):
    made = {"date": "date_add(DATE'2020-01-01', CAST(id AS int))", "timestamp": "timestamp_seconds(id)"}
    made["timestamp_ntz"] = "CAST(timestamp_seconds(id) AS timestamp_ntz)"
    df = spark.range(40).selectExpr(f"IF(id = 3, NULL, {made.get(kind, f'CAST(id AS {kind})')}) AS k", "concat('row ', id) AS t")
    index = trigrams.build_index(df, "k", str(tmp_path / "i"), parts=4)
    assert sorted(r["t"] for r in trigrams.find_text(spark, index, "ROW 3").collect()) == sorted(f"row {i}" for i in (3, *range(30, 40)))


def test_index_refusals_and_an_empty_table(spark, texts, index, tmp_path):
    with pytest.raises(Refused):
        trigrams.find_text(spark, index, "  ")
    with pytest.raises(Refused):
        trigrams.build_index(texts.select("id", "n"), "id", str(tmp_path / "n"))
    empty = trigrams.build_index(texts.where("id < 0"), "id", str(tmp_path / "e"), ["T"])
    assert empty.fields == ("t",)
    assert trigrams.find_text(spark, empty, "alpha").count() == trigrams.find_text(spark, empty, "a").count() == 0
