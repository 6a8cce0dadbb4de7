import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from kinlink.llm import warc
from kinlink.llm.workdir import fresh_folder

PAGE = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        lead = first.get(h or "")
        again = lead is not None and i != lead
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a.example/x y\n", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b.example", None), (4, "u", ""), (5, "v", "x" * 700_000), (6, "w", "WARC/1.1\r\n\r\nnot a header"), (7, "w", "a\r\n\r\nb"), (None, "n", "<p>é</p>"), (None, "n", "alone")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGE).repartition(3)
    got = sorted(map(tuple, warc.warc_digest(pages).collect()), key=str)
    assert got == brute(ROWS)


def test_query_against_sql(spark):
    import duckdb

    pages = spark.createDataFrame(ROWS, PAGE)
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    got = sorted(map(tuple, warc.warc_digest(pages).collect()), key=str)
    assert got == sorted(con.sql(warc.ORACLE).fetchall(), key=str)


def test_writers_check_their_chunks(spark):
    rows = warc.chunk_table(warc.classify(spark.createDataFrame([(1, "u", "abc" * 900)], PAGE)), 1000)
    batch = rows.toArrow().to_batches()
    wrong = rows.withColumn("sha1", F.lit("0" * 40)).mapInArrow(warc._writer(fresh_folder(spark, "w")), "archive string, records long")
    assert sum(b.num_rows for b in batch) == 3
    try:
        wrong.collect()
    except Exception as e:
        assert "do not make the payload" in str(e)
    else:
        raise AssertionError("damage went unnoticed")


def test_chunks_carry_digests(spark):
    pages = spark.createDataFrame(ROWS, PAGE)
    manifest = warc.write_archives(pages, fresh_folder(spark, "w"), chunk_bytes=1000)
    chunks = warc.read_archives(manifest, chunk_bytes=777)
    big = sorted((r for r in chunks.where("page_id = 5").collect()), key=lambda r: r.chunk)
    data = b"x" * 700_000
    assert len(big) == -(-700_000 // 777) and [r.is_last for r in big] == [False] * (len(big) - 1) + [True]
    for k in (0, 5, len(big) - 1):
        part = data[: 777 * (k + 1)]
        assert big[k].bytes_so_far == len(part) and big[k].digest_so_far == base64.b32encode(hashlib.sha1(part).digest()).decode()
    texts = {(r.page_id, r.html) for r in warc.payload_texts(chunks).collect()}
    assert texts == {(1, "<p>é</p>"), (2, ""), (5, "x" * 700_000), (6, ROWS[5][2]), (7, ROWS[6][2]), (None, "alone")}


def test_archives_are_plain_warc(spark):
    manifest = warc.write_archives(spark.createDataFrame(ROWS[:1], PAGE), fresh_folder(spark, "w"))
    path = manifest.first().archive.removeprefix("file://")
    with gzip.open(path) as f:
        raw = f.read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"<p>\xc3\xa9</p>\r\n\r\n")
    assert b"WARC-Target-URI: http://a.example/x%20y%0A\r\n" in raw


def test_least_size_of_revisits(spark):
    rows = [(1, "a", "short"), (2, "b", "short"), (3, "c", "long enough"), (4, "d", "long enough")]
    kinds = {r.page_id: r.refers_to for r in warc.classify(spark.createDataFrame(rows, PAGE), min_bytes=6).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}


def test_damage_is_noticed():
    head = warc.record_head(1, "u", 3, hashlib.sha1(b"abc").hexdigest(), None)
    list(warc.read_records(io.BytesIO(head + b"abc\r\n\r\n")))
    for bad in (head + b"abd\r\n\r\n", head + b"ab"):
        try:
            list(warc.read_records(io.BytesIO(bad)))
        except ValueError:
            continue
        raise AssertionError("damage went unnoticed")


def test_empty_repeated_and_extra(spark):
    assert warc.warc_digest(spark.createDataFrame([], PAGE)).count() == 0
    rows = [(1, "a", "same"), (1, "a", "same"), (2, "b", "same")]
    pages = spark.createDataFrame(rows, PAGE).withColumns({"sha1": F.lit(1), "chunk": F.lit(2), "payload": F.lit(3)})
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.warc_digest(pages).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
