"""WARC archives: round trips, predicates that reach the reader, payloads that are not touched, attempts that do not count."""

import collections
import gzip
import hashlib
import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.runtime import scratch_path

SCHEMA = "page_id long, url string, html string, payload string, digest int, salt string, first long"
LONG = "<p>word</p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40_000


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", "".join(rng.choice("ab é\r\n日<>\x00") for _ in range(rng.choice([0, 5, 99, 100, 3000])))) for i in range(120)]
    copy, edge = "same " * 40, "e" * 100
    rows += [(i, "u", copy) for i in range(200, 320)]  # a hot group
    rows += [(400, "u", edge[:99]), (401, "u", edge[:99]), (402, "u", edge), (403, "u", edge), (404, None, "é" * 50), (405, None, "é" * 50)]
    rows += [(500, "bad\r\nWARC-Type: revisit", "q" * 200), (501, "u", None), (502, None, ""), (None, "n", copy), (None, "n", "lone" * 50), (None, "n", "none " * 40), (None, "n", "none " * 40)]
    rows += [(600, "u", "twice" * 30), (600, "u", "twice" * 30), (601, "u", "twice" * 30), (-7, "u", copy), (700, "long", LONG), (701, "long", LONG)]
    return rows


def brute(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= 100:
            first[p] = min(first.get(p, i), i)
    found = []
    for i, p in payloads:
        revisit = p in first and i != first[p]
        found.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(found, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "s", 2) for r in rows], SCHEMA).repartition(4)


def read_all(spark, path):
    return sorted(map(tuple, warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_pages_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", broadcast)
    path = scratch_path(spark, "warc")
    warc.write_pages(frame(spark, pages()), path)
    assert read_all(spark, path) == brute(pages())
    back = spark.read.format("warc").load(path)
    urls = {r["record_id"]: r["target_uri"] for r in back.collect()}
    assert len(urls) >= 250 and any(u == "bad%0D%0AWARC-Type: revisit" for u in urls.values())
    assert back.where("record_type = 'response' AND http_status = 200").count() == sum(r[3] == "response" for r in brute(pages()))
    texts = collections.Counter(bytes(r["payload"]) for r in back.where("record_type = 'response'").select("payload").collect())
    assert texts[LONG.encode()] == 1 and texts[("same " * 40).encode()] == 1


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    warc.write_pages(frame(spark, pages()).where("page_id = -1"), path)
    assert read_all(spark, path) == []


def records(spark, n=60):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "revisit").otherwise("response").alias("record_type"), F.format_string("<urn:r:%d>", "id").alias("record_id"),
        F.lit("2020-01-01T00:00:00Z").alias("record_date"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("http://h/"), "id")).alias("target_uri"),
        F.col("id").alias("x_number"), F.lit("text/plain").alias("content_type"), F.repeat(F.lit("payload "), F.col("id").cast("int") * 50).cast("binary").alias("payload"))


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("condition", [
    "record_type = 'revisit'", "record_type IN ('response', 'other') AND x_number > 10", "target_uri LIKE 'http://h/1%'", "target_uri IS NULL", "NOT target_uri = 'http://h/1'",
    "target_uri <> 'http://h/2' OR x_number = 2", "x_number <= 5 AND x_number >= 2 AND target_uri IS NOT NULL", "target_uri > 'http://h/3'", "target_uri LIKE '%7'", "content_length < 500",
    "octet_length(payload) > 1000 AND record_type = 'response'"])
def test_predicates_give_what_spark_gives(spark, tmp_path_factory, compression, condition):
    path = str(tmp_path_factory.mktemp("w"))
    warc.register(spark)
    written = records(spark)
    written.write.format("warc").option("compression", compression).option("splitBytes", 2000).mode("append").save(path)
    schema = "record_id string, record_type string, target_uri string, x_number long, payload binary, content_length long"
    got = spark.read.format("warc").schema(schema).load(path).where(condition)
    want = written.withColumn("content_length", F.octet_length("payload").cast("long")).where(condition)
    assert sorted(map(tuple, got.select("record_id", "payload").collect())) == sorted(map(tuple, want.select("record_id", "payload").collect()))


def test_predicates_are_pushed_and_files_split(spark, tmp_path):
    warc.register(spark)
    records(spark).coalesce(1).write.format("warc").option("compression", "none").option("splitBytes", 2000).mode("append").save(str(tmp_path))
    data = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path))
    assert data.rdd.getNumPartitions() > 5 and data.count() == 60
    plan = data.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)


def test_unwanted_payloads_are_not_inflated(spark, tmp_path):
    """Bytes in the middle of the revisits' blocks are broken; only who reads those payloads notices."""
    warc.register(spark)
    name = tmp_path / "a.warc.gz"
    rng = random.Random(1)
    with open(name, "wb") as out:
        for i in range(20):
            kind = "revisit" if i % 2 else "response"
            member = bytearray(warc._gzipped(warc.record_bytes({"record_type": kind, "record_id": f"<urn:{i}>", "record_date": "d"}, rng.randbytes(200_000)), 1))
            if kind == "revisit":
                member[100_000:100_050] = bytes(50)
                member[-8:-4] = b"abcd"
            out.write(member)
    data = spark.read.format("warc").schema("record_id string, record_type string, payload binary").load(str(name))
    assert [len(r["payload"]) for r in data.where("record_type = 'response'").collect()] == [200_000] * 10
    assert spark.read.format("warc").schema("record_id string").load(str(name)).count() == 20
    with pytest.raises(Exception, match="incorrect data check|invalid|Error"):
        data.where("record_type = 'revisit'").select(F.sum(F.octet_length("payload"))).collect()


def test_archives_of_other_writers(spark, tmp_path):
    record = (b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Target-URI: http://a\r\n b\r\nX-Odd\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n")
    bodies = [b"", b"one", b"x" * 700_000, b"WARC/1.0\r\n\r\n"]
    with open(tmp_path / "b.warc.gz", "wb") as out:
        for i, b in enumerate(bodies):
            out.write(gzip.compress(record % (i, len(b), b)))
    with open(tmp_path / "c.warc", "wb") as out:
        for i, b in enumerate(bodies):
            out.write(record % (10 + i, len(b), b))
    (tmp_path / "notes.txt").write_text("no archive")
    warc.register(spark)
    got = spark.read.format("warc").schema("record_id string, target_uri string, payload binary, headers map<string,string>, http_status int").load(str(tmp_path)).collect()
    assert {(r["record_id"], bytes(r["payload"])) for r in got} == {(f"<urn:{i}>", b) for k in (0, 10) for i, b in enumerate(bodies, k)}
    assert {r["target_uri"] for r in got} == {"http://a b"} and all(r["headers"]["warc-type"] == "resource" and r["http_status"] is None for r in got)


def test_files_without_a_manifest_entry_do_not_count(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path)
    records(spark, 30).write.format("warc").mode("append").save(path)
    with open(os.path.join(path, f"part-{uuid.uuid4().hex}.warc.gz"), "wb") as out:  # a lost attempt
        out.write(b"\x1f\x8b half a mem")
    assert spark.read.format("warc").load(path).count() == 30
    records(spark, 10).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 40
    records(spark, 5).write.format("warc").mode("overwrite").save(path)
    assert spark.read.format("warc").load(path).count() == 5
    with pytest.raises(Exception, match="record_id"):
        spark.range(1).write.format("warc").mode("append").save(path)
