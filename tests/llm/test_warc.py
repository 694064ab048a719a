import gzip
import random

import pytest

from corpusloom.llm.warc import parse_warc, read_warc, resolve_revisits, with_payload

SCHEMA = "record_id string, url string, ts bigint, kind string, headers map<string,string>, digest string, outcome string, payload string"


def brute(rows):
    out = {}
    for i, url, ts, kind, headers, digest, *_ in rows:
        if kind != "revisit":
            continue
        past = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and None not in (ts, r[2]) and r[2] < ts]
        if not past:
            out[i] = ("missing", None)
            continue
        best = max(past, key=lambda r: (r[2], r[0]))
        low = [{k.lower(): v for k, v in (h or {}).items()} for h in (headers, best[4])]
        if all("etag" in h for h in low):
            same = low[0]["etag"] == low[1]["etag"]
        elif all("last-modified" in h for h in low):
            same = low[0]["last-modified"] == low[1]["last-modified"]
        else:
            same = digest is not None and digest == best[5]
        out[i] = ("resolved" if same else "changed", best[0])
    return out


@pytest.mark.parametrize("span", [20_000, 3])
def test_equals_brute_force_in_any_spans(spark, span):
    rnd = random.Random(span)
    rows = []
    for i in range(300):
        url = rnd.choice(["hot", "hot", "hot", "b", "c", None])
        headers = rnd.choice([{"ETag": rnd.choice("xy")}, {"Last-Modified": rnd.choice("12")}, {}, None])
        rows.append((f"r{i:03}", url, rnd.choice([None, rnd.randrange(60), rnd.randrange(60)]), rnd.choice(["response", "revisit", "request"]), headers, rnd.choice(["d", "e", None]), "z", "p"))
    got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), span).collect()}
    assert got == brute(rows)


def test_headers_merge_and_payload(spark):
    rows = [
        ("a", "u", 1, "response", {"Content-Length": "9", "Date": "old", "X-Keep": "1", "ETag": "W/\"v\""}, "d1", None, "body"),
        ("b", "u", 2, "revisit", {"Content-Length": "0", "DATE": "new", "etag": "\"v\"", "Cache-Control": "no"}, None, None, None),
        ("b", "u", 2, "revisit", {"Content-Length": "0", "DATE": "new", "etag": "\"v\"", "Cache-Control": "no"}, None, None, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = with_payload(resolve_revisits(frame), frame).collect()
    assert len(got) == 2 and got[0]["payload"] == "body" and got[0]["digest"] == "d1"
    assert got[0]["headers"] == {"content-length": "9", "date": "new", "x-keep": "1", "etag": "\"v\"", "cache-control": "no"}
    assert resolve_revisits(frame.limit(0)).collect() == []


def record(kind, uri, head, body=b""):
    block = head + b"\r\n\r\n" + body
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-0{1 if kind == 'response' else 2}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_files_round_trip(spark, tmp_path):
    raw = record("request", "https://a.com/x", b"GET /x HTTP/1.1") + record("response", "https://www.a.com/x/", b"HTTP/1.1 200 OK\r\nETag: q\r\nVia: a\r\nVia: b", b"payload\r\n\r\nmore") + record("revisit", "https://a.com/x#f", b"HTTP/1.1 304 Not Modified\r\nETag: q")
    assert [r[3:5] for r in parse_warc(raw)] == [("response", 200), ("revisit", 304)] and list(parse_warc(b"")) == []
    with pytest.raises(ValueError):
        list(parse_warc(b"not a record"))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "empty.warc").write_bytes(b"")
    records = read_warc(spark, str(tmp_path))
    row = with_payload(resolve_revisits(records), records).first()
    assert (row["outcome"], row["url"], bytes(row["payload"]), row["headers"]["via"]) == ("resolved", "a.com/x", b"payload\r\n\r\nmore", "a, b")


def test_a_burst_in_one_second_is_cut_into_spans(spark):
    rows = [(f"r{i:04}", "hot", 7 if i < 900 else 8, "response" if i % 3 == 0 else "revisit", {"ETag": str(i % 2)}, None, None, None) for i in range(1000)]
    got = {r["record_id"]: (r["outcome"], r["response_id"]) for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), 50).collect()}
    assert got == brute(rows)


def test_revisits_of_a_same_payload_keep_their_headers(spark):
    same, other = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    rows = [("a", "u", 1, "response", {"ETag": "1", "Via": "x"}, "d", None), ("b", "u", 2, "revisit", {"ETag": "2", "Date": "n"}, "d", same), ("c", "u", 3, "revisit", {"ETag": "1"}, "e", same)]
    rows += [("d", "u", 4, "revisit", {"ETag": "1"}, None, other), ("e", "u", 5, "revisit", {"ETag": "1"}, "e", None)]
    frame = spark.createDataFrame(rows, "record_id string, url string, ts bigint, kind string, headers map<string,string>, digest string, profile string")
    got = {r["record_id"]: r for r in resolve_revisits(frame).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"b": "resolved", "c": "changed", "d": "resolved", "e": "resolved"}
    assert got["b"]["headers"] == {"ETag": "2", "Date": "n"} and got["d"]["headers"] == {"etag": "1", "via": "x"}


def test_repeated_responses_multiply_no_rows(spark):
    rows = [("a", "u", 1, "response", {"ETag": "1"}, "d", None, "one"), ("a", "u", 1, "response", {"ETag": "1"}, "d", None, "two"), ("b", "u", 2, "revisit", {"ETag": "1"}, None, None, None), ("c", "v", 2, "revisit", {}, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = with_payload(resolve_revisits(frame), frame).collect()
    assert sorted((r["record_id"], r["payload"]) for r in got if r["payload"]) == [("b", "two")] and len(got) == 2
    assert with_payload(resolve_revisits(frame.limit(0)), frame).collect() == []


def test_broken_files_lose_no_more_than_what_is_broken(spark, tmp_path):
    one = record("response", "https://a.com/1", b"HTTP/1.1 200 OK", b"one")
    two = record("response", "https://a.com/2", b"HTTP/1.1 200 OK", b"two" * 1000)
    files = {"junk.warc": b"junk\r\n" + one + b"more junk\r\n\r\n" + two, "length.warc": one.replace(b"Content-Length: ", b"Content-Length: x") + two, "cut.warc": one + two[:-40], "none.warc": b"\r\n\r\n"}
    files |= {"cut.warc.gz": gzip.compress(one) + gzip.compress(two)[:-30], "bad.warc.gz": gzip.compress(one) + b"\x1f\x8b broken"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        found = [r[1][-1] for r in parse_warc(data, strict=False)]
        assert found == {"junk.warc": ["1", "2"], "length.warc": ["2"], "none.warc": []}.get(name, ["1"])
    assert sorted(r["url"] for r in read_warc(spark, str(tmp_path)).collect()) == ["a.com/1"] * 4 + ["a.com/2"] * 2
    for data in (files["length.warc"], files["cut.warc"], files["cut.warc.gz"]):
        with pytest.raises(ValueError):
            list(parse_warc(data))


def test_many_records_leave_in_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc").write_bytes(b"".join(record("response", f"https://a.com/{i}", b"HTTP/1.1 200 OK", b"x" * i) for i in range(2500)))
    got = read_warc(spark, str(tmp_path)).selectExpr("count(*)", "sum(length(payload))", "count(distinct url)").first()
    assert tuple(got) == (2500, 2500 * 2499 // 2, 2500)


def test_only_full_responses_stand_for_a_revisit(spark):
    tag = {"ETag": '"t"'}
    rows = [("a", "u", 1, "response", tag, "d1", 200), ("b", "u", 2, "response", tag, "d2", 206), ("c", "u", 3, "response", tag, "d3", 304), ("d", "u", 4, "response", tag, "d4", 500),
            ("e", "u", 5, "response", {**tag, "content-range": "bytes 0-1/9"}, "d5", 200), ("f", "u", 6, "response", tag, "d6", None), ("r", "u", 9, "revisit", tag, None, 304)]
    records = spark.createDataFrame(rows, "record_id string, url string, ts long, kind string, headers map<string,string>, digest string, status int")
    got = resolve_revisits(records).first()
    assert (got["response_id"], got["outcome"], got["digest"]) == ("a", "resolved", "d1")
    assert resolve_revisits(records.drop("status")).first()["response_id"] == "f"


def test_payloads_meet_columns_of_any_name(spark):
    resolved = spark.createDataFrame([("r", "a", "resolved", "x", "y", "z"), ("s", "a", "changed", "x", "y", "z")], "record_id string, response_id string, outcome string, __id string, __wanted string, row string")
    records = spark.createDataFrame([("a", "response", bytearray(b"body"))], "record_id string, kind string, payload binary")
    got = with_payload(resolved, records)
    assert got.columns == [*resolved.columns, "payload"]
    assert {(r["record_id"], r["__id"], r["__wanted"], r["payload"] and bytes(r["payload"])) for r in got.collect()} == {("r", "x", "y", b"body"), ("s", "x", "y", None)}
