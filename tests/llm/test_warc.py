import glob
import hashlib

import pytest
import zstandard

from lacuna.llm import warc

SCHEMA = "page_id bigint, url string, html string, bundle int"


def plain(rows, least=100):
    out = []
    for page, _, html, _ in rows:
        body = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None)
        again = len(body) >= least and page is not None and first < page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_round_trip(spark, broadcast_rows):
    rows = [(i, f"http://h/{i}\r\nX: y", ("é<p>" + "x" * (i % 7) * 40 + "\r\n\r\n") * (i % 5), 1) for i in range(120)]
    rows += [(None, None, "z" * 200, 1), (None, "u", "z" * 200, 1), (500, "u", "z" * 200, 1), (500, "u", "z" * 200, 1), (501, "u", "z" * 200, 1), (502, "u", None, 1), (503, "u", "WARC/1.1\r\n" * 30_000, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = warc.round_trip(df, frame_bytes=2000, bundle_bytes=3000, broadcast_rows=broadcast_rows)
    assert sorted(str((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to)) for x in got.collect()) == plain(rows)


def test_bundles_are_seekable_zstandard(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50, 0) for i in range(100)]
    path = f"{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, frame_bytes=5000)
    (name,) = glob.glob(f"{path}/*/part-*")
    data = open(name, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 100 and len(warc.Reader(data).places) > 5
    found = warc.index(spark, path)
    assert found.count() == 100
    ids = {str(warc.name_of(i, 0, 0)): i for i in (3, 50, 99)}
    got = warc.fetch(spark, path, found.where(found.record_id.isin(*ids)))
    assert {ids[x.record_id]: bytes(x.payload).decode() for x in got.collect()} == {i: rows[i][2] for i in ids.values()}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
