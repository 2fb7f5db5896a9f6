import base64
import glob
import gzip
import hashlib
import io
import json
import random

import pytest

from framelake.llm import spread
from framelake.llm.warc import _header, archive_pages, normalise, read_records, record_bytes


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        seen = first.get(h or "")
        revisit = seen is not None and seen != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", seen if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spread, "SHARE", 9)
    rng = random.Random(1)
    texts = ["", None, "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>", "x" * 300_000] + ["".join(rng.choice("ab<>é\n\r") for _ in range(rng.randrange(2000))) for _ in range(30)]
    rows = [(k, rng.choice([None, "http://x.example/é?q=1\n2", "a b"]), rng.choice(texts)) for k in range(200)]
    rows += [(None, "u", "only nameless"), (None, None, texts[5]), (3, "again", rows[3][2])]
    out = archive_pages(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string"), folder=f"file://{tmp_path}/archives")
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
    folder = f"{tmp_path}/archives"
    seen = 0
    for path in glob.glob(f"{folder}/*.warc.gz"):
        data = open(path, "rb").read()
        for line in open(f"{path}.index"):
            entry = json.loads(line)
            member = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and _header(member, "WARC-Record-ID") == entry["id"]
            seen += 1
    assert seen == len(rows)
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_normaliser_keeps_every_record_and_spots_damage():
    records = [record_bytes(k, None, bytes([k]) * (k * 70_000), None, False) for k in range(5)]
    for source in (gzip.compress(b"".join(records)), b"".join(gzip.compress(r) for r in records)):
        target, index = io.BytesIO(), io.BytesIO()
        members = normalise(io.BytesIO(source), target, index)
        assert [gzip.decompress(target.getvalue()[a : a + n]) for a, n in members] == records
        a, n = members[2][0], members[2][1] + members[3][1]
        part = io.BytesIO(target.getvalue()[a:])
        assert [_header(h, "WARC-Record-ID") for h, _ in read_records(part, n)] == ["<urn:framelake:page:2>", "<urn:framelake:page:3>"]
    with pytest.raises(EOFError):
        normalise(io.BytesIO(gzip.compress(b"".join(records))[:-50_00]), io.BytesIO(), io.BytesIO())
