import gzip
import hashlib

from commentarium.llm.warc import archive, parse, read_archives, write_archives

SCHEMA = "page_id bigint, url string, html string, digest int"


def pages(spark):
    long = "<p>" + "é" * 200
    return spark.createDataFrame(
        [(1, "http://a/ü\r\nX-Evil: 1", long, 0), (2, "http://b", long, 0), (3, None, "short", 0), (4, "http://c", "short", 0), (5, "http://d", None, 0),
         (6, "http://e", "", 0), (None, "http://f", long, 0), (7, "http://g", "WARC/1.1\r\n\r\n" * 50, 0), (8, "http://h", "z" * 300_000, 0), (2, "http://b2", long, 0)],
        SCHEMA,
    )


def summary(df):
    return sorted(
        ((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str
    )


def test_round_trip(spark):
    want = []
    for p in pages(spark).collect():
        payload = (p["html"] or "").encode()
        revisit = p["page_id"] == 2
        want.append((p["page_id"] or 0, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    back = archive(pages(spark))
    assert summary(back) == sorted(want, key=str)
    by_page = {r["page_id"]: r for r in back.collect()}
    assert by_page[1]["payload"] == ("<p>" + "é" * 200).encode() and by_page[2]["payload"] is None
    assert by_page[1]["url"] == "http://a/ü%0D%0AX-Evil:%201"


def test_files_roll_and_bytes_repeat(spark, tmp_path):
    manifests = []
    for k, parts in enumerate((1, 6)):
        folder = f"file://{tmp_path}/{k}"
        rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").repartition(parts)
        manifest = write_archives(rows, folder, roll_bytes=20_000, shard_bytes=100_000)
        manifests.append(sorted((r["path"].rsplit("/", 1)[1], r["records"], r["bytes"], r["sha256"]) for r in manifest.collect()))
        files = {p.name: p for p in (tmp_path / str(k)).glob("*.warc.gz")}
        assert set(files) == {m[0] for m in manifests[-1]}
        for name, records, size, digest in manifests[-1]:
            data = files[name].read_bytes()
            assert (len(data), hashlib.sha256(data).hexdigest()) == (size, digest)
            assert len(list(parse(iter([data[:100], data[100:]])))) == records + 1
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert read_archives(manifest).count() == rows.count()
    assert manifests[0] == manifests[1] and len(manifests[0]) > 2


def test_empty_table(spark):
    assert archive(pages(spark).limit(0)).count() == 0
