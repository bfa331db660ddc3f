"""ZIP packages: round trips, ZIP64, other writers' files, and damage."""

import hashlib
import io
import json
import zipfile

import pytest

from seqframe.llm import warc_zip as wz

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


LONG = "é" * 60
ROWS = [(1, "http://a/", LONG), (2, None, None), (3, "http://b/\nx", ""), (7, "u", "short"), (6, "u", "short"), (9, "u", LONG), (4, "u", LONG), (11, "u", "z" * 300_000), (12, "u", "y" * 100)]


def test_round_trip(spark):
    out = wz.archive_round_trip(pages(spark, ROWS))
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        again = html == LONG and i != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if again else ("response", None))
        assert r.payload == (None if again else body)
    assert wz.archive_round_trip(pages(spark, [])).collect() == []
    odd = wz.archive_round_trip(pages(spark, [(None, None, LONG), (5, "u", LONG), (5, "u", LONG), (None, "u", LONG)])).collect()
    assert [(r.page_id, r.record_type) for r in sorted(odd, key=lambda r: str(r.page_id))] == [(5, "response"), (5, "response"), (None, "response"), (None, "response")]


def test_several_packages_and_zip64(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 50) for i in range(200)]
    for zip64 in (False, True):
        folder = str(tmp_path / str(zip64))
        manifest = wz.write_packages(pages(spark, rows), folder, package_bytes=2000, zip64=zip64)
        files = manifest.collect()
        assert sum(r.records for r in files) == 200 and len(files) > 5
        for r in files:
            with zipfile.ZipFile(r.path) as z:  # another reader agrees
                assert z.testzip() is None and z.namelist() == [wz.ARCHIVE, wz.INDEX]
        got = {r.page_id: bytes(r.payload).decode() for r in wz.read_packages(manifest, folder, per_row=7).collect()}
        assert got == {i: t for i, _, t in rows}


def _zip(compress=zipfile.ZIP_STORED, comment=b"", index=None):
    a, b = (wz.record_bytes("response", "u", i, t, hashlib.sha256(t).hexdigest(), None) for i, t in ((1, b"one"), (2, b"two")))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", compress) as z:
        z.comment = comment
        z.writestr(wz.ARCHIVE, a + b)
        z.writestr(wz.INDEX, index or "\n".join(json.dumps({"page": i, "offset": o, "length": n}) for i, o, n in ((1, 0, len(a)), (2, len(a), len(b)))))
    return buf.getvalue()


def _payloads(data):
    f = io.BytesIO(data)
    return [wz.parse_record(data[at : at + n])["payload"] for at, n in wz.index_entries(f, len(data))]


def test_other_writers_files():
    assert _payloads(_zip()) == [b"one", b"two"]
    assert _payloads(_zip(comment=b"a comment with PK\x05\x06 inside, and more of it")) == [b"one", b"two"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"12345")
        z.writestr("dir/", b"")
    r = wz.PackageReader(io.BytesIO(buf.getvalue()), len(buf.getvalue()))
    at, n = r.data_of("big")
    assert buf.getvalue()[at : at + n] == b"12345"


@pytest.mark.parametrize(
    "data, message",
    [(b"", "not a ZIP"), (b"PK" * 50, "not a ZIP"), (_zip()[:-4], "not a ZIP"), (_zip(zipfile.ZIP_DEFLATED), "isn't stored"), (_zip(index=json.dumps({"page": 1, "offset": 5, "length": 10**6})), "points out"), (_zip().replace(b"PK\x01\x02", b"PK\x01\x03"), "central directory")],
)
def test_damage(data, message):
    with pytest.raises(ValueError, match=message):
        _payloads(data)
