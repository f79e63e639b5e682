import gzip
import hashlib
import random

import pytest

from gaugeline.llm import warc
from gaugeline.sources.tables import fresh_path


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(1)
    copies, small = "c" * 100, "s" * 99
    out = [(i, f"http://x/{i}", "".join(draw.choice("aé\r\nWARC/1.1 \x00") for _ in range(draw.randint(0, 900)))) for i in range(40)]
    out += [(50, "u", copies), (41, "v\r\nX: y", copies), (60, None, copies), (70, "w", small), (71, "w", small)]
    out += [(80, "n", None), (81, "n", ""), (None, "o", copies), (90, "p", "é" * 60_000), (90, "p", "é" * 60_000), (91, "q", "WARC/1.1\r\n\r\n" * 300)]
    return out


def _want(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        of = first.get(data)
        again = of is not None and page != of
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", of if again else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment, chunk", [(64, 10), (1000, 300), (1 << 20, 1 << 20)])
def test_round_trip(spark, rows, segment, chunk):
    folder = fresh_path(spark, "test-warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write(pages, folder, segment=segment, chunk=chunk)
    back = warc.read(spark, folder)
    assert sorted(map(tuple, warc.pages(back).collect()), key=str) == _want(rows)
    payloads = {r.headers["x-page-id"]: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    for page, _, html in rows[:40]:
        assert payloads[str(page)] == (html or "").encode()


def test_empty_and_extra_columns(spark):
    folder = fresh_path(spark, "test-warc")
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest string, size int")
    warc.write(pages, folder)
    assert warc.read(spark, folder).count() == 0
    folder = fresh_path(spark, "test-warc")
    warc.write(spark.createDataFrame([(1, "u", "x", "d", 1)], pages.schema), folder)
    assert warc.pages(warc.read(spark, folder)).first().payload_bytes == 1


def _file(*parts):
    out = []
    for fields, block in parts:
        head = "".join(f"{k}: {v}\r\n" for k, v in [*fields.items(), ("Content-Length", len(block))])
        out.append(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")
    return out


def test_segments_from_several_files(spark, tmp_path):
    whole = b"HTTP/1.1 200 OK\r\n\r\nabcdefghij"
    first = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Segment-Number": "1"}

    def more(k, **extra):
        return {"WARC-Type": "continuation", "WARC-Record-ID": f"<a{k}>", "WARC-Segment-Origin-ID": "<a>", "WARC-Segment-Number": str(k), **extra}

    last = more(3, **{"WARC-Segment-Total-Length": str(len(whole))})
    parts = _file((more(2), whole[10:20]), (last, whole[20:]), (first, whole[:10]), ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x"))
    (tmp_path / "1.warc").write_bytes(parts[0] + parts[3])
    (tmp_path / "2.warc.gz").write_bytes(gzip.compress(parts[1]) + gzip.compress(parts[2]))
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert set(got) == {"<a>", "<i>"}
    assert bytes(got["<a>"].payload) == b"abcdefghij" and got["<a>"].problem is None and got["<a>"].record_type == "response"
    assert bytes(got["<i>"].payload) == b"software: x"


def test_faults_are_reported(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def segment(origin, k, block, total=None):
        fields = {"WARC-Type": "continuation" if k > 1 else "response", "WARC-Record-ID": f"<{origin}{'' if k == 1 else k}>", "WARC-Segment-Number": str(k)}
        fields |= {"WARC-Segment-Origin-ID": f"<{origin}>"} if k > 1 else {}
        return fields | ({"WARC-Segment-Total-Length": str(total)} if total is not None else {}), block

    records = [
        segment("gap", 1, b"a"), segment("gap", 3, b"b", 2), segment("open", 1, b"a"), segment("short", 1, b"a"), segment("short", 2, b"b", 9),
        ({"WARC-Type": "response", "WARC-Record-ID": "<chunks>"}, http + b"5\r\nab"),
        ({"WARC-Type": "response", "WARC-Record-ID": "<digest>", "WARC-Payload-Digest": "sha256:00"}, http + b"2\r\nab\r\n0\r\n\r\n"),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(_file(*records)))
    problems = {r.record_id: r.problem for r in warc.read(spark, str(tmp_path)).collect()}
    assert problems == {
        "<gap>": "segments [1, 3]", "<open>": "last segment is missing", "<short>": "2 bytes of 9", "<chunks>": "chunk is cut",
        "<digest>": "payload digest differs",
    }


def test_damaged_records_are_rows(spark, tmp_path):
    good = {"WARC-Type": "warcinfo", "WARC-Record-ID": "<good>"}
    ((whole,), (bad,)) = (_file((f, b"abc")) for f in (good, good | {"WARC-Record-ID": "<bad>"}))
    cases = {
        "junk": (b"junk\r\n" + whole, "no record at byte 0"),
        "header": (whole + bad[:20], f"header is cut at byte {len(whole)}"),
        "inner": (bad[:20] + b"\r\n" + whole, "header is cut at byte 0"),
        "block": (whole + bad[:-6], f"block is cut at byte {len(whole) + len(bad) - 6}"),
        "length": (bad.replace(b"Content-Length: 3", b"Length: 3") + whole, "no content length"),
        "number": (bad.replace(b"Content-Length", b"WARC-Segment-Number: x\r\nContent-Length") + whole, "segment number or length is no number"),
        "cut": (gzip.compress(whole) + gzip.compress(bad)[:-9], "gzip member is cut"),
        "zip": (gzip.compress(whole) + b"\x1f\x8b" + b"\xff" * 30, None),
    }
    for name, (content, _) in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / "x.warc").write_bytes(content)
        rows = warc.read(spark, str(folder)).collect()
        assert [bytes(r.payload) for r in rows if r.problem is None and r.record_id == "<good>"] == [b"abc"], name
    for name, (content, problem) in cases.items():
        found = [p for _, _, p in warc.records(content) if p]
        assert len(found) == 1 and (problem is None or found == [problem]), name
    assert list(warc.records(b"")) == [] and len(list(warc.records(whole))) == 1
