import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.llm import warc as W
from veilframe.sources.scratch import new_folder

PAGES = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", None), (4, None, ""), (5, "http://d\r\nX: y", "é" * 5000),
         (6, "http://e", "other"), (6, "http://e", "other"), (7, "http://f", "same"), (7, "http://f", "two payloads"), (None, "http://g", "same"),
         (None, "http://h", "alone")]
SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(least=0):
    keeper = {}
    for i, _, html in PAGES:
        keeper[html or ""] = max((x for x in (i, keeper.get(html or "")) if x is not None), default=None)
    out = []
    for i, _, html in PAGES:
        last, size = keeper[html or ""], len((html or "").encode())
        revisit = last is not None and i != last and size >= least
        out.append((i, size, digest(html), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4, 5, 100_000])
def test_records(spark, frame, rows_of, least):
    folder = new_folder(spark, "warc-test")
    W.write_archive(frame([(*p, 1) for p in PAGES], SCHEMA + ", payload int"), folder, least_revisit_bytes=least)
    out = W.read_records(W.reconstruct(spark, folder))
    assert rows_of(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(least)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({p[2] or "" for p in PAGES})


def test_a_hot_payload_is_in_many_tasks(spark, frame):
    folder = new_folder(spark, "warc-hot")
    pages = frame([(i, f"u{i}", "hot" if i % 3 else f"own {i}") for i in range(4000)], SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    W.write_archive(pages, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    out = W.read_records(W.reconstruct(spark, folder))
    assert out.where("record_type = 'revisit' AND refers_to = 3998").count() == 2665 and out.count() == 4000
    files = [spark.read.parquet(f).where("is_revisit").count() for f in spark.read.parquet(f"{folder}/headers").inputFiles()]
    assert sum(n > 100 for n in files) > 1


def test_round_trip(spark, frame):
    folder = new_folder(spark, "warc-trip")
    W.write_archive(frame(PAGES, SCHEMA), folder)
    records = sorted(bytes(r.record) for r in W.reconstruct(spark, folder).collect())
    assert len(records) == len(PAGES)
    bodies = []
    for record in records:
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        body = rest[:-4]
        assert int(fields[b"Content-Length"]) == len(body) and fields[b"WARC-Date"] == b"1970-01-01T00:00:00Z"
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"].decode() == "sha1:" + digest(body.decode())
            bodies.append(body)
        else:
            assert not body and b"WARC-Profile" in fields and fields[b"WARC-Refers-To"].startswith(b"<urn:page:")
    responses = Counter(r[2] for r in expected() if r[3] == "response")
    assert Counter(digest(b.decode()) for b in bodies) == responses


def test_damage_is_found(spark, frame):
    folder = new_folder(spark, "warc-damage")
    W.write_archive(frame(PAGES[:3], SCHEMA), folder)
    stored = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
    stored.write.parquet(f"{folder}-copy/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{folder}-copy/headers")
    with pytest.raises(Exception, match="damaged payload"):
        W.reconstruct(spark, f"{folder}-copy").collect()
    records = W.reconstruct(spark, folder)
    longer = records.withColumn("record", F.concat("record", F.lit("x").cast("binary")))
    with pytest.raises(Exception, match="damaged record"):
        W.read_records(longer)
    other = records.withColumn("record", F.regexp_replace(F.col("record").cast("string"), "same", "emas").cast("binary"))
    with pytest.raises(Exception, match="damaged record"):
        W.read_records(other)
    with pytest.raises(ValueError, match="not there"):
        W.read_records(records.where("page_id <> 2"))


def test_no_pages(spark, frame):
    folder = new_folder(spark, "warc-none")
    W.write_archive(frame([], SCHEMA), folder)
    assert W.read_records(W.reconstruct(spark, folder)).count() == 0


def test_base32(spark, frame):
    got = frame([("abc",), ("",)], "t string").select("t", W.base32(F.sha1(F.col("t").cast("binary"))).alias("d")).collect()
    assert {r.t: r.d for r in got} == {"abc": digest("abc"), "": digest("")}
