"""Round trips through files and stored tables."""

import pytest
from helpers import leads, log, rows_of
from pyspark.sql import functions as F

from prospectry import schemas
from prospectry.operators import hosts, roster
from prospectry.sources import lists, sinks, tables


def test_domain_map_round_trip(spark, tmp_path):
    rows = [(0, "B", "x", "b.test"), (1, "A", "", "a.test")]
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.write_domain_map(spark.createDataFrame(rows, schemas.DOMAIN_MAP), first)
    assert spark.read.text(first).orderBy("value").first().value.startswith("# name")
    known = lists.read_domain_map(spark, first)
    assert rows_of(known.select("name", "country", "domain"), "name") == [
        ("A", "", "a.test"), ("B", "x", "b.test")]
    found = spark.createDataFrame([(0, "C", "y", "c.test")], schemas.DOMAIN_MAP)
    sinks.write_domain_map(roster.merge_domain_map(known, found), second)
    assert [r.name for r in lists.read_domain_map(spark, second).orderBy("name").collect()] == [
        "A", "B", "C"]


def test_seeds_grow_once(spark, tmp_path):
    path = str(tmp_path / "seeds")
    spark.createDataFrame([("# mine",), ("https://www.known.test/",)], "value string").write.text(path)
    found = spark.createDataFrame([("known.test",), ("new.test",)], "host string")
    for _ in range(2):
        seeds = tables.written(lists.read_seed_urls(spark, path))
        sinks.append_seeds(hosts.seed_additions(found, seeds), path)
    assert sorted(r.url for r in lists.read_seed_urls(spark, path).collect()) == [
        "https://new.test/", "https://www.known.test/"]


def test_stored_tables(spark, tmp_path):
    leads(spark, {"email": "a@x.test"}).write.parquet(str(tmp_path / "leads"))
    log(spark, {"lead_id": 1}).write.parquet(str(tmp_path / "log"))
    assert tables.read_leads(spark, str(tmp_path / "leads")).columns == schemas.LEADS.names
    assert tables.read_outreach(spark, str(tmp_path / "log")).first().delivery == "sent"
    spark.createDataFrame([(1, "u", ""), (2, "v", None), (3, "w", "<p>")], schemas.PAGES).write.parquet(
        str(tmp_path / "pages"))
    assert [r.page_id for r in tables.read_pages(spark, str(tmp_path / "pages")).collect()] == [3]


def test_spread_deals_rows_out_where_asked(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert tables.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100, numPartitions=64)
    assert tables.spread(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_drafts_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@x.test")], "lead_id bigint, to string")
    sinks.write_drafts(df.withColumn("body", F.lit("x\ny")), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().body == "x\ny"


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(tables, "SHARED", "spark.some.folder.dir")
    with pytest.raises(ValueError, match="spark.some.folder.dir"):
        tables.work_dir(spark)
