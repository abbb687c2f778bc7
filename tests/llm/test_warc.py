from __future__ import annotations

import hashlib
import io
import struct
import zipfile

import pytest

from tidelog.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def reader(data: bytes):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_files(zip64):
    members = [("a/ü.bin", b"\x00" * 10), ("b", b""), ("c", b"PK\x05\x06" * 30)]
    data = warc.zip_archive(members, comment_length=4, zip64=zip64) + b"note"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == members and z.comment == b"note"
    found = warc.read_directory(reader(data), len(data))
    assert [(m.name, data[warc.data_offset(reader(data), m) :][: m.size]) for m in found] == members


def test_foreign_archives_and_broken_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr("packed", b"abc" * 99, zipfile.ZIP_DEFLATED)
    data = out.getvalue()
    stored, packed = warc.read_directory(reader(data), len(data))
    assert data[warc.data_offset(reader(data), stored) :][:3] == b"abc"
    with pytest.raises(ValueError, match="not stored"):
        warc.data_offset(reader(data), packed)
    for bad in (b"", b"x" * 100, data[:-5]):
        with pytest.raises((ValueError, struct.error)):
            warc.read_directory(reader(bad), len(bad))


def test_records_are_read_by_range_alone():
    payloads = [b"", b"x" * 5000, bytes(range(256)), b"\r\n\r\nWARC/1.1\r\n\r\n"]
    records = [(i, f"http://h/{i}\r\nX: y", p, hashlib.sha256(p).hexdigest(), 1 if i == 3 else None) for i, p in enumerate(payloads)]
    (data,) = warc.pack(iter(records))
    data += b"\n"
    touched = []

    def read(at, n):
        touched.append(n)
        return data[at : at + n]

    entries = list(warc.index_entries(read, len(data)))
    assert max(touched) < 66_000
    got = list(warc.read_ranges(read, entries, request_bytes=1))
    assert touched[-4:] == [n for _, n in entries]
    del touched[:]
    assert list(warc.read_ranges(read, entries)) == got and len(touched) == 1
    assert [r.payload for r in warc.read_ranges(read, entries[::2])] == payloads[::2]
    assert [r.payload for r in got] == [*payloads[:3], b""]
    assert got[3].headers["WARC-Type"] == "revisit" and int(got[3].http["Content-Length"]) == len(payloads[3])
    assert "X" not in got[0].headers
    assert len(list(warc.pack(iter(records), archive_bytes=1))) == 4


def test_an_archive_of_five_gigabytes(tmp_path):
    """Offsets above 32 bits come from the ZIP64 records; of a sparse file only the ranges asked for are read."""
    payload = b"far away " * 99
    (small,) = warc.pack(iter([(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)]))
    end = small.rindex(warc.END)
    shift, directory = 5 << 30, warc._END64.unpack_from(small, small.rindex(warc.END64))
    moved = bytearray(small + b"\n")
    at = directory[9]
    for _ in range(2):  # the place of a member is the last field of its extra record
        name, extra = struct.unpack_from("<2H", small, at + 28)
        place = at + warc._CENTRAL.size + name + extra - 8
        struct.pack_into("<Q", moved, place, struct.unpack_from("<Q", small, place)[0] + shift)
        at += warc._CENTRAL.size + name + extra
    struct.pack_into("<Q", moved, small.rindex(warc.END64) + 48, directory[9] + shift)
    struct.pack_into("<Q", moved, end - warc._LOCATOR.size + 8, small.rindex(warc.END64) + shift)
    path = tmp_path / "part-large"
    with path.open("wb") as f:
        f.seek(shift)
        f.write(moved)
    with warc.opened(f"file:{path}") as file:
        read = lambda at, n: file.read_at(n, at)
        (got,) = warc.read_ranges(read, list(warc.index_entries(read, file.size())))
    assert got.payload == payload


def test_a_page_larger_than_an_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    monkeypatch.setattr(warc, "REQUEST_BYTES", 1000)
    rows = [(i, "u", "".join(chr(33 + (i * k * k) % 90) for k in range(400 * i))) for i in range(1, 30)]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}


def test_round_trip(spark):
    big, small = "é" * 60, "short"
    rows = [(1, "u", big), (2, "u", big), (3, None, None), (4, "v", small), (5, "v", small), (2, "w", big), (None, "n", big), (6, "z" * 5000, "y" * 300_000), (9, "t", "own" * 50), (9, "t", "own" * 50)]
    got = [tuple(r)[:5] for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i != first[h]
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_an_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", "c", "d")], SCHEMA + ", payload string, first string")
    assert warc.round_trip(df).count() == 1
    assert warc.round_trip(df.limit(0)).count() == 0
