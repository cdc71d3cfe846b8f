import base64
import hashlib
import io
import random
import struct

import pytest
import zstandard

from tracekiln.llm import common, warc_zst
from tracekiln.llm.warc_zst import DICT_MAGIC, WarcError, frames, parse, record, write_archive


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, archive string")


def rows():
    rng = random.Random(4)
    html = lambda n: "<p>" + " ".join(rng.choice(["alpha", "beta", "é", "漢"]) for _ in range(n)) + "</p>"
    out = [(i, f"http://x.com/{i}", html(rng.randint(1, 300)), "a") for i in range(60)]
    same = html(40)
    out += [(i, f"http://y.com/{i}", same, "a") for i in range(100, 140)]
    return out + [(200, None, None, "a"), (201, "http://z.com/\r\nX: y", "", "a"), (None, "u", "no id", "a"), (None, "u", same, "a"),
                  (202, "http://b.com", html(200_000), "a"), (203, "http://t.com", "twice", "a"), (203, "http://t.com", "twice", "a")]


@pytest.mark.parametrize("least", [0, 1, 10_000])
def test_round_trip(spark, least):
    data = rows()
    archives = warc_zst.write_archives(pages(spark, data).repartition(3), common.scratch_path(spark, "w"), least, max_bytes=20_000)
    got = sorted((tuple(r) for r in warc_zst.read_archives(archives).drop("archive", "uri").collect()), key=repr)
    first = {}
    for page, _, html, _ in data:
        p = (html or "").encode()
        if page is not None and len(p) >= least:
            first[p] = min(first.get(p, page), page)
    want = []
    for page, _, html, _ in data:
        p = (html or "").encode()
        refers = first.get(p) if len(p) >= least and first.get(p) != page else None
        sha = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((page, "response" if refers is None else "revisit", len(p), sha, refers, bytearray(p) if refers is None else None))
    assert got == sorted(want, key=repr)


def test_no_pages(spark):
    archives = warc_zst.write_archives(pages(spark, []), common.scratch_path(spark, "w"))
    assert warc_zst.read_archives(archives).collect() == []


def archive(tmp_path, n=40):
    path = tmp_path / "a.warc.zst"
    rng = random.Random(1)
    recs = [record(i, f"http://x/{i}", (" ".join(rng.choice(["abc", "def", "ghi"]) for _ in range(400))).encode(), None, False) for i in range(n)]
    assert write_archive(str(path), iter(recs)) == n
    return path, recs


def test_layout(tmp_path):
    path, recs = archive(tmp_path)
    raw = path.read_bytes()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == DICT_MAGIC
    d = zstandard.ZstdCompressionDict(raw[8:8 + size])
    assert list(frames(io.BytesIO(raw), "a")) == recs
    assert zstandard.ZstdDecompressor(dict_data=d).decompress(raw[8 + size:]) == recs[0]
    # the format also allows a compressed dictionary, and none
    packed = zstandard.ZstdCompressor().compress(raw[8:8 + size])
    assert list(frames(io.BytesIO(struct.pack("<II", DICT_MAGIC, len(packed)) + packed + raw[8 + size:]), "a")) == recs
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in recs[:3])
    assert list(frames(io.BytesIO(plain), "a")) == recs[:3]
    assert list(frames(io.BytesIO(b""), "a")) == []


def test_damage_is_reported(tmp_path):
    path, _ = archive(tmp_path)
    raw = path.read_bytes()
    for bad in (raw[:-5], raw[:6], raw[:100], raw[:-200] + b"\0" * 200, raw + b"junk"):
        with pytest.raises(WarcError):
            for n, r in enumerate(frames(io.BytesIO(bad), "a")):
                parse(r, str(n))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WORC/1.1"), (b"WARC-Type: ", b"WARC-Tipe: "), (b"Content-Length: 91", b"Content-Length: 90"),
                                      (b"payload", b"paylaod"), (b"WARC-Date", b"WARC-Dat")])
def test_bad_records(old, new):
    data = record(1, "http://x", b"payload text", None, False)
    assert parse(data, "x")["payload"] == b"payload text"
    assert old in data
    with pytest.raises(WarcError):
        parse(data.replace(old, new), "x")
