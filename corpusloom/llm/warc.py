"""WARC revisit records: as-of join to the latest earlier full response, validators, header merge.

A not-modified revisit carries no payload. It stands for the latest full response of the same canonical URL that
was captured before it, if its validators agree: equal entity tags, or, where one side has none, equal
modification dates, or equal payload digests. The response's headers are then updated by those that a
not-modified answer may replace (RFC 9111, 3.2); all others stay the response's.

A revisit of the profile ``identical-payload-digest`` was answered in full: its headers are its own, and it stands for the
latest earlier response only if the payload digests agree.

Responses and revisits are one table, ordered by time within a URL; no pairs are made. URLs with very many
captures are cut into spans of equal counts in that order, however many captures share a second. The last responses of spans are carried over
by a window of one row per span, so no task sorts more than a span. DataFrame functions only; parsing raw WARC files is Arrow-batched.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.order import with_group_position

#: Captures of one URL in a span.
SPAN_ROWS = 20_000
#: Bytes of payload, and records, in one batch of a parsed file, about.
BATCH_BYTES, BATCH_RECORDS = 16 << 20, 1000

#: Fields of a stored response that a not-modified answer does not replace.
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]

#: Fixed value: the end of the name of the profile of revisits whose payload was compared.
SAME_PAYLOAD = "identical-payload-digest"


def header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Lower-cased names; permitted fields of the fresh headers replace or join the stored ones. Null maps are empty."""

    def low(m: Column) -> Column:
        """Of names that differ in case only, the first stays."""
        names = F.array_distinct(F.transform(F.map_keys(m), F.lower))
        values = F.transform(names, lambda n: F.get(F.map_values(F.map_filter(m, lambda k, v: F.lower(k) == n)), F.lit(0)))
        return F.coalesce(F.map_from_arrays(names, values), F.create_map().cast("map<string,string>"))

    allowed = F.map_filter(low(fresh), lambda k, v: ~k.isin(KEPT_FIELDS))
    kept = F.map_filter(low(stored), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _agree(a: Column, b: Column) -> Column:
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    return weak(a) == weak(b)


def resolve_revisits(records: DataFrame, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One row per revisit of ``records(record_id, url, ts, kind, headers, digest)``; url is canonical, kind response or revisit.

    Returns ``record_id, url, ts, response_id, response_ts, outcome, digest, headers``. Outcomes: ``resolved``;
    ``changed`` if the latest earlier response's validators differ or share none (its id is given, headers stay the revisit's);
    ``missing`` without an earlier response. A column ``profile`` is optional: null and unknown ones are revisits that were not modified. Responses count
    if they are full: without a Content-Range, and of status 200 where there is a column ``status``. Defined
    cases: earlier is strict; of responses at one time the greatest
    record_id counts; a null url or time resolves nothing; repeated revisits are resolved each; rows of other kinds and extra
    columns are ignored; names of headers match in any case.
    """
    fields = F.struct("ts", "record_id", "headers", "digest")
    profile = F.coalesce(F.col("profile").endswith(SAME_PAYLOAD), F.lit(False)) if "profile" in records.columns else F.lit(False)
    # only a full response can stand for a revisit: not a part of one, an error, or another word that nothing has changed
    whole = header(F.col("headers"), "content-range").isNull()
    whole = whole & (F.col("status") == 200) if "status" in records.columns else whole
    chosen = (F.col("kind") == "revisit") | ((F.col("kind") == "response") & F.coalesce(whole, F.lit(False)))
    events = records.where(chosen).select("record_id", "url", "ts", "kind", "headers", "digest", profile.alias("full"))
    usable = events.where("url is not null and ts is not null")
    is_response = F.col("kind") == "response"
    # of equal times revisits come first, so that only strictly earlier responses stand before them
    order = [F.col("ts"), is_response.cast("int"), F.col("record_id")]
    sizes = usable.groupBy("url").agg(F.count("*").alias("n")).where(F.col("n") > span_rows).select("url")
    calm, rows = usable.join(sizes, "url", "left_anti"), usable.withColumn("span", F.lit(0).cast("long"))
    crowded = not sizes.isEmpty()
    if crowded:
        placed = with_group_position(usable.join(sizes, "url", "left_semi"), "url", *order, name="__place")
        rows = calm.withColumn("span", F.lit(0).cast("long")).union(placed.withColumn("span", F.floor(F.col("__place") / span_rows).cast("long")).drop("__place"))
    within = Window.partitionBy("url", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("r", F.last(F.when(is_response, fields), ignorenulls=True).over(within)).where("kind = 'revisit'")
    if crowded:
        large = rows.join(sizes, "url", "left_semi")
        last = large.groupBy("url", "span").agg(F.max_by(F.when(is_response, fields), F.when(is_response, F.struct("ts", "record_id"))).alias("r"))
        before = Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.select("url", "span", F.last("r", ignorenulls=True).over(before).alias("carried"))
        found = found.join(carried, ["url", "span"], "left").withColumn("r", F.coalesce("r", "carried")).drop("carried")
    out = found.drop("span", "kind").unionByName(events.where("(url is null or ts is null) and kind = 'revisit'").drop("kind"), allowMissingColumns=True)
    mine, theirs = F.col("headers"), F.col("r.headers")
    same = F.col("digest") == F.col("r.digest")
    agree = F.coalesce(_agree(header(mine, "etag"), header(theirs, "etag")), header(mine, "last-modified") == header(theirs, "last-modified"), same, F.lit(False))
    fits = F.when(F.col("full"), F.coalesce(same, F.lit(False))).otherwise(agree)
    out = out.withColumn("outcome", F.when(F.col("r").isNull(), "missing").when(fits, "resolved").otherwise("changed"))
    merged = F.when((F.col("outcome") == "resolved") & ~F.col("full"), merge_headers(theirs, mine)).otherwise(mine)
    return out.select("record_id", "url", "ts", F.col("r.record_id").alias("response_id"), F.col("r.ts").alias("response_ts"), "outcome", F.when(F.col("outcome") == "resolved", F.col("r.digest")).alias("digest"), merged.alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload of the response they stand for.

    Defined cases: rows of other outcomes, and those whose response is not among the records, have a null payload; of responses of one
    record id the greatest payload counts, so no row is multiplied; repeated revisits stay; an empty table gives an empty result.
    """
    bodies = records.where("kind = 'response' and record_id is not null").groupBy(F.col("record_id").alias("response_id")).agg(F.max("payload").alias("payload"))
    kept = [c for c in resolved.columns if c != "payload"]
    rows = resolved.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.when(F.col("outcome") == "resolved", F.col("response_id")).alias("response_id"))
    return rows.join(bodies, "response_id", "left").select(*(F.col("row")[c].alias(c) for c in kept), "payload")


def _fields(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
    return found


def _length(warc: dict[str, str]) -> int:
    """The declared length of a record's block; -1 if it is missing or no number."""
    text = warc.get("content-length", "")
    return int(text) if text.isascii() and text.isdigit() else -1


def parse_warc(data: bytes, strict: bool = True) -> Iterator[tuple]:
    """``(record_id, url, date, kind, status, headers, digest, profile, payload)`` of the response and revisit records of one file, one at a time.

    Defined cases: what is no record, has no sound length or breaks off raises ValueError if strict. Else it is skipped up to the next
    line that begins a record, and a file or gzip member that breaks off ends with its last whole record. An empty file holds nothing.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)

    def bad(what: str) -> None:
        if strict:
            raise ValueError(what)

    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    bad("not a WARC record")
                continue
            head = [line]
            while (line := stream.readline()) and line.strip():
                head.append(line)
            warc = _fields(b"".join(head))
            size, kind = _length(warc), warc.get("warc-type")
            if size < 0:
                bad("a record without a length")
                continue
            if kind not in ("response", "revisit"):
                while size and (skipped := len(stream.read(min(size, 1 << 20)))):
                    size -= skipped
                continue
            body = stream.read(size)
            if len(body) < size:
                return bad("a record breaks off")
            top, _, payload = body.partition(b"\r\n\r\n")
            status = top.split(b"\r\n", 1)[0].split()
            yield (
                warc.get("warc-record-id"), warc.get("warc-target-uri"), warc.get("warc-date"), kind, int(status[1]) if len(status) > 1 and status[1].isdigit() and len(status[1]) < 6 else None,
                _fields(top), warc.get("warc-payload-digest"), warc.get("warc-profile"), payload if kind == "response" else None,
            )
    except (EOFError, OSError, zlib.error):
        bad("a gzip member is broken")


_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.binary()]
_NAMES = ["record_id", "target", "date", "kind", "status", "headers", "digest", "profile", "payload"]


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [[list(x.items()) for x in c] if i == 5 else list(c) for i, c in enumerate(zip(*rows))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of WARC files, gzipped or not, from any file system that Spark reads.

    A file is one task's work, up to the 2 GB that Spark reads into a binary value; its records are parsed one at a time and leave in bounded
    batches. Broken files and records are passed over as in ``parse_warc``; a date that is none is null; a folder without files gives no rows.
    """
    from .url_filter import canonical_url

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for row in parse_warc(data.as_py(), strict=False):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)

    raw = spark.read.format("binaryFile").load(path).select("content")
    rows = raw.mapInArrow(kernel, "record_id string, target string, date string, kind string, status int, headers map<string,string>, digest string, profile string, payload binary")
    return rows.select("record_id", canonical_url(F.col("target")).alias("url"), F.try_to_timestamp("date").alias("ts"), "kind", "status", "headers", "digest", "profile", "payload")
