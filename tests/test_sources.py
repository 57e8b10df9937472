"""Readers and writers round-trip, and refuse what they must refuse."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.records import present
from catalogspark.schema import COLUMNS
from catalogspark.sources import readers, writers
from catalogspark.sources.index import scale_up


@pytest.fixture()
def record(spark):
    base = {c: None for c in COLUMNS} | {"reference_number": "R-1", "brand": "Maker", "description": 'say "hi", ok\nline two'}
    return spark.createDataFrame([tuple(base[c] for c in COLUMNS)], ", ".join(f"{c} string" for c in COLUMNS))


def test_csv_round_trip(spark, record, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(record.withColumn("extra", F.lit("dropped")), path)
    back = readers.read_csv_strict(spark, path)
    assert back.columns == list(COLUMNS) and back.first().asDict() == record.first().asDict()


def test_csv_header_must_match(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("brand,reference_number\nA,1\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_csv_strict(spark, str(tmp_path / "bad.csv"))


def test_jsonl_round_trip_and_corrupt_line(spark, record, tmp_path):
    path = str(tmp_path / "jsonl")
    writers.write_jsonl(record, path)
    assert readers.read_records(spark, path).first()["brand"] == "Maker"
    (tmp_path / "broken.jsonl").write_text('{"brand":"A"}\n{broken\n')
    got = readers.read_records(spark, str(tmp_path / "broken.jsonl")).cache()
    assert [r["_corrupt_record"] for r in got.where("_corrupt_record is not null").collect()] == ["{broken"]


def test_document(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{\n "records": [{"id": 7}]\n}')
    doc = readers.read_document(spark, str(tmp_path / "doc.json"))
    assert doc.select(F.try_variant_get("doc", "$.records[0].id", "int")).first()[0] == 7


def test_snapshots_are_verified(spark, tmp_path):
    folder = tmp_path / "snapshots"
    folder.mkdir()
    good = hashlib.sha256(b"page").hexdigest()
    (folder / good).write_bytes(b"page")
    bad = hashlib.sha256(b"other").hexdigest()
    (folder / bad).write_bytes(b"altered")
    manifest = spark.createDataFrame([("u1", good, "t"), ("u2", bad, "t"), ("u3", "0" * 64, "t")], "url string, sha256 string, fetched_at string")
    verified, rejected = readers.read_snapshots(spark, str(folder), manifest)
    assert [(r["url"], bytes(r["content"])) for r in verified.collect()] == [("u1", b"page")]
    assert sorted((r["url"], r["reason"]) for r in rejected.collect()) == [("u2", "hash mismatch"), ("u3", "missing body")]


def test_sitemaps(spark, tmp_path):
    folder = tmp_path / "maps"
    folder.mkdir()
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    (folder / "a.xml").write_text(f"<?xml version='1.0'?><urlset {ns}><url><loc> https://x/1 </loc><image:image><image:loc>https://x/i.png</image:loc></image:image></url></urlset>")
    (folder / "b.xml.gz").write_bytes(gzip.compress(f"<sitemapindex {ns}><sitemap><loc>https://x/s.xml</loc></sitemap></sitemapindex>".encode()))
    (folder / "c.xml").write_text('<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]><urlset><url><loc>&e;</loc></url></urlset>')
    (folder / "d.xml").write_text("<html></html>")
    (folder / "e.xml").write_text("<urlset>" + "<!-- " + "x" * (17 << 20) + " --><url><loc>https://x/big</loc></url></urlset>")
    found, refused = readers.read_sitemaps(spark, str(folder))
    assert sorted((r["kind"], r["loc"]) for r in found.collect()) == [("index", "https://x/s.xml"), ("urlset", "https://x/1"), ("urlset", "https://x/big")]
    assert sorted((r["file"][-5:], r["reason"]) for r in refused.collect()) == [("c.xml", "has a DOCTYPE"), ("d.xml", "not a sitemap")]


def test_every_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("brand,note\nx,1\n")
    (tmp_path / "b.csv").write_text("note,brand\n1,x\n")
    with pytest.raises(Exception):
        readers.read_csv_strict(spark, str(tmp_path), ["brand", "note"]).collect()


def test_export_splits_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "R1", None), ("b", None, "x")], "brand string, reference_number string, note string")
    quality = writers.export_records(df, str(tmp_path / "out"), {"no reference": ~present("reference_number")}, ["brand", "reference_number", "note"])
    assert {r["metric"]: r["n"] for r in quality.collect()} == {
        "accepted": 1, "quarantined": 1, "missing_brand": 0, "missing_reference_number": 0, "missing_note": 1}
    assert spark.read.json(str(tmp_path / "out/quarantine")).first()["errors"] == ["no reference"]
    assert spark.read.csv(str(tmp_path / "out/watches_csv"), header=True).count() == 1


def test_partition_overwrite_touches_one_dataset(spark, tmp_path):
    path = str(tmp_path / "cat")
    writers.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "id long, dataset string"), path, "dataset")
    writers.overwrite_partitions(spark.createDataFrame([(3, "a")], "id long, dataset string"), path, "dataset")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]
    writers.write_by(spark.createDataFrame([(1, "wrist"), (2, "pocket")], "id long, subtype string"), str(tmp_path / "by"), "subtype")
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["subtype=pocket", "subtype=wrist"]


def test_state_table_and_scale_up(spark, tmp_path):
    spark.createDataFrame([("u", "pending")], "url string, status string").write.parquet(str(tmp_path / "queue"))
    assert readers.read_state(spark, str(tmp_path), "queue").first()["status"] == "pending"
    with pytest.raises(ValueError):
        readers.read_state(spark, str(tmp_path), "secrets")
    big = scale_up(spark.createDataFrame([("a",), ("b",)], "id string"), 5)
    assert big.select("id").distinct().count() == 10
