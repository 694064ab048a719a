"""Removing every byte of a string of a given length that stands anywhere else, by suffix arrays of shards.

Equal strings must meet in one shard, and a shard must fit a task. Every string has an anchor: of its short grams the one with the least hash, the leftmost of equals. It follows
from the string alone, so strings with different anchors differ, and strings without an anchor that occurs twice are unique. Neighbouring strings mostly share theirs: the strings of one
anchor are a run, and the bytes that they cover are a segment. Segments are counted by digest; where an anchor has different ones, each is sent to the shard of the anchor once, with
its number. An anchor with one segment only has nothing to compare.

Within a shard suffixes are ordered by induced sorting and compared by permuted common prefixes: the strings that begin at neighbouring places with a common prefix of the length are equal.

A gram that stands in many different segments would make a shard of any size. Its strings are parted by where they hold it: those of a range of offsets share more bytes around the gram,
and these are their new key. Ranges are halved until a key is held by few segments or a range is one offset, where the key is the whole string and segments with it are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import bucketed, materialize
from .arrow_text import text_slices
from .suffix_arrays import equal_prefixes

#: Bytes of a string that part its grams at most; shorter strings have shorter grams.
GRAM = 64
#: Strings that begin in one piece of a long text.
PIECE = 1 << 18
#: Bytes of a slice, whose positions are numbered by so many bits.
SLICE, PLACE_BITS = 1 << 20, 22
#: Segments that a key may have before its strings are parted, and bytes of a shard on average.
CROWDED, SHARD = 256, 1 << 20


def gram_length(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place where so many are left: polynomials doubled in width, then mixed."""
    with np.errstate(over="ignore"):
        powers, base = [(1, data.astype(np.uint64) + np.uint64(1))], 0x9E3779B97F4A7C15
        while 2 * powers[-1][0] <= gram:
            w, h = powers[-1]
            powers.append((2 * w, h[:-w] * np.uint64(pow(base, w, 1 << 64)) + h[w:]))
        width, out = powers[-1]
        for w, h in powers[-2::-1]:
            if width + w <= gram:
                out = out[: len(out) - w] * np.uint64(pow(base, w, 1 << 64)) + h[width : width + len(out) - w]
                width += w
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys."""
    least, w = keys, 1
    while 2 * w <= width:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    rest = width - w
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """``(text, at, first, last, hash)`` of every run of strings with one anchor; places count within the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data, gram = np.frombuffer(b"".join(texts), np.uint8), gram_length(length)
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(data, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (window_minima((hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1) & mask).astype(np.int64)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= (starts + sizes)[owner]
    anchor[~whole] = -1
    first = np.flatnonzero(whole & (np.diff(anchor, prepend=-1) != 0))
    last = np.flatnonzero(whole & (np.diff(anchor, append=-1) != 0))
    text, at = owner[first], anchor[first]
    return text, at - starts[text], first - starts[text], last - starts[text], hashes[at].view(np.int64)


def repeated_strings(segments: list[bytes], strings: np.ndarray, weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, first, last)``: runs of strings that stand more than once among the first ``strings`` ones of each segment, which counts ``weights`` times."""
    sizes = np.array([len(x) for x in segments], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(segments)), sizes)
    own = np.arange(len(text)) - starts[owner] < strings[owner]
    order, group = equal_prefixes(text, length)
    weight = np.where(own, weights[owner], 0)
    more = np.zeros(len(text), bool)
    more[order] = np.bincount(group, weights=weight[order])[group] > 1
    more &= own
    edge = lambda x: x != 0
    run = np.where(more, owner, -1)
    first, last = np.flatnonzero(more & edge(np.diff(run, prepend=-1))), np.flatnonzero(more & edge(np.diff(run, append=-1)))
    segment = owner[first]
    return segment, first - starts[segment], last - starts[segment]


def merged(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of bytes that strings beginning at the given runs cover."""
    order = np.argsort(first, kind="stable")
    start, stop = first[order], np.maximum.accumulate(last[order] + length)
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], stop[np.append(new[1:], True)]


def _anchored(pieces: DataFrame, length: int) -> DataFrame:
    """``doc, piece, at, first, last, key`` of every anchor of ``pieces(doc, piece, t)``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t", SLICE):
                text, at, first, last, key = anchors(part.column("t").to_pylist(), length)
                ids = [part.column(c).take(pa.array(text)) for c in ("doc", "piece")]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(x.astype(np.int32)) for x in (at, first, last)), pa.array(key)], ["doc", "piece", "at", "first", "last", "key"])

    return pieces.mapInArrow(kernel, "doc binary, piece bigint, at int, first int, last int, key bigint")


def _class(data: Column, key: Column, at: Column, low: Column) -> Column:
    """A digest that equal segments of one key share; 16 bytes."""
    place = F.concat_ws("-", key, at, low).cast("binary")
    return F.unhex(F.substring(F.sha2(F.concat(place, F.lit(":").cast("binary"), data), 256), 1, 32))


def _with_sizes(classes: DataFrame) -> DataFrame:
    """``classes`` with ``n``, the number of classes of their key."""
    classes = materialize(classes)
    return materialize(classes.join(materialize(classes.groupBy("key").agg(F.count("*").alias("n"))), "key"))


def _parted(classes: DataFrame, length: int) -> DataFrame:
    """Segments of crowded keys as segments of both halves of their range of offsets, as ``up, base`` and the columns of a segment."""
    middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low").alias("l"), (middle - 1).alias("h")), F.struct(middle.alias("l"), F.col("high").alias("h")))).alias("half")
    # a string that begins w bytes into the segment holds the anchor at offset at - w
    cut = classes.select("class", "at", "strings", "data", "weight", "key", halves)
    cut = cut.select("*", F.greatest(F.lit(0), F.col("at") - F.col("half.h")).alias("w0"), F.least(F.col("strings") - 1, F.col("at") - F.col("half.l")).alias("w1")).where("w0 <= w1")
    held = F.substring(F.col("data"), F.col("at") - F.col("half.l") + 1, F.col("half.l") + (length - F.col("half.h")))
    return cut.select(
        F.col("class").alias("up"), F.col("w0").alias("base"), F.xxhash64("key", "half.l", held).alias("key"), (F.col("at") - F.col("w0")).alias("at"), (F.col("w1") - F.col("w0") + 1).alias("strings"),
        F.col("half.l").alias("low"), F.col("half.h").alias("high"), F.substring(F.col("data"), F.col("w0") + 1, F.col("w1") - F.col("w0") + length).alias("data"), "weight",
    )


def _sharded(classes: DataFrame, length: int) -> DataFrame:
    """``class, first, last``: the repeated strings of every class, by suffix arrays of shards."""
    size = classes.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-size // SHARD))

    def kernel(table: pa.Table) -> pa.Table:
        strings, weights = (table.column(c).to_numpy() for c in ("strings", "weight"))
        segment, first, last = repeated_strings(table.column("data").to_pylist(), strings, weights, length)
        return pa.Table.from_arrays([table.column("class").take(pa.array(segment)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["class", "first", "last"])

    dealt = classes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "class", "strings", "weight", "data")
    return dealt.groupBy("shard").applyInArrow(kernel, "class binary, first int, last int")


def _runs(members: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``doc, first, last``: runs of repeated strings of ``members(doc, base, class, key, at, strings, weight)``, segments without their bytes.

    The bytes of a segment are fetched where its key has another one, once for all that are equal; a key with one class has nothing to compare.
    """
    rep = F.min(F.struct("doc", "base")).alias("rep")
    classes = members.groupBy("class").agg(rep, *(F.any_value(c).alias(c) for c in ("key", "at", "strings")), F.sum("weight").alias("weight"))
    classes = _with_sizes(classes)
    lone = [classes.where("n = 1 and weight > 1").select("class", F.lit(0).alias("first"), (F.col("strings") - 1).alias("last"))]
    wanted = classes.where("n > 1").select(F.col("rep.doc").alias("doc"), F.col("rep.base").alias("base"), "class", "key", "at", "strings", "weight", "n")
    data = F.substring(F.col("text").cast("binary"), (F.col("base") + 1).cast("int"), F.col("strings") + (length - 1))
    held = texts.join(wanted, "doc").select("class", "key", "at", "strings", F.lit(0).alias("low"), F.lit(length - gram_length(length)).alias("high"), data.alias("data"), "weight", "n")
    levels, mixed = [members.select("doc", "base", "class")], []
    while True:
        held = materialize(held)
        mixed.append(held.where(F.col("n") <= CROWDED).select("class", "key", "strings", "weight", "data"))
        crowded = held.where(F.col("n") > CROWDED)
        if crowded.isEmpty():
            break
        rows = _parted(crowded, length).withColumn("class", _class(F.col("data"), F.col("key"), F.col("at"), F.col("low")))
        rows = materialize(rows)
        levels.append(rows.select("up", "base", "class"))
        classes = _with_sizes(rows.groupBy("class").agg(*(F.any_value(c).alias(c) for c in ("key", "at", "strings", "low", "high", "data")), F.sum("weight").alias("weight")))
        lone.append(classes.where("n = 1 and weight > 1").select("class", F.lit(0).alias("first"), (F.col("strings") - 1).alias("last")))
        held = classes.where("n > 1")
    found = materialize(reduce(DataFrame.union, [_sharded(reduce(DataFrame.union, mixed), length), *lone]))
    place = lambda members, runs, to: members.join(runs, "class").select(to, (F.col("base") + F.col("first")).alias("first"), (F.col("base") + F.col("last")).alias("last"))
    runs = found
    for part in levels[:0:-1]:
        runs = materialize(found.unionByName(place(part, runs, "up").withColumnRenamed("up", "class")))
    return place(levels[0], runs, "doc")


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """``doc, spans`` of those of ``texts(doc, text, copies)`` that hold a repeated string."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("text") - F.lit(length)) / F.lit(PIECE)))).alias("piece")
    piece = lambda p: F.substring(F.col("text").cast("binary"), (p * PIECE + 1).cast("int"), F.lit(PIECE + length - 1))
    pieces = texts.where(F.octet_length("text") >= length).select("doc", "text", start).select("doc", "piece", piece(F.col("piece")).alias("t"))
    found = materialize(_anchored(pieces, length))
    often = materialize(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    listed = found.join(often, "key", "left_semi").groupBy("doc", "piece").agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("held"))  # those of one piece
    cut = lambda x: F.struct(x["key"].alias("key"), (x["at"] - x["first"]).alias("at"), (x["last"] - x["first"] + 1).alias("strings"), x["first"].alias("first"), _class(F.substring(F.col("t"), x["first"] + 1, x["last"] - x["first"] + length), x["key"], x["at"] - x["first"], F.lit(0)).alias("class"))
    members = texts.join(listed, "doc").select("doc", "piece", "copies", piece(F.col("piece")).alias("t"), "held").select("doc", "piece", "copies", F.explode(F.transform("held", cut)).alias("s"))
    members = materialize(members.select("doc", (F.col("piece") * PIECE + F.col("s.first")).alias("base"), "s.class", "s.key", "s.at", "s.strings", F.col("copies").alias("weight")))
    runs = _runs(members, texts, length).groupBy("doc").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))  # those of one text

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [merged(np.asarray(a.values), np.asarray(b.values), length) for a, b in zip(batch.column("first"), batch.column("last"))]
            sizes = np.cumsum([0, *(len(a) for a, _ in rows)]).astype(np.int32)
            ends = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(ends, names=["start", "stop"]))], ["doc", "spans"])

    return runs.mapInArrow(kernel, "doc binary, spans array<struct<start:bigint,stop:bigint>>")


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes of each text outside its spans."""
    out = []
    for text, cuts in zip(texts, spans):
        data, at, parts = text.as_py(), 0, []
        for cut in cuts.as_py() or []:
            parts.append(data[at : cut["start"]])
            at = cut["stop"]
        out.append(b"".join([*parts, data[at:]]))
    return pa.array(out, pa.binary())


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (maximal spans of bytes, ``start`` to before ``stop``) and ``kept``, the bytes that remain.

    A byte goes if a string of ``length`` bytes that covers it begins at any other place of the input, in the same document or another; first occurrences go too. Texts are UTF-8, cut at any byte;
    null texts are empty and keep nothing; texts shorter than ``length`` stay; rows with equal texts of that length go as a whole; ids play no part; an empty table gives an
    empty result; columns named as a result are replaced, all others stay.
    """
    results = ["n_bytes", "removed", "kept"]
    others = [c for c in docs.columns if c not in results]
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    # grouped by the digest, they are in their buckets already
    texts = bucketed(docs.select(text.alias("text"), doc.alias("doc")).groupBy("doc").agg(F.any_value("text").alias("text"), F.count("*").alias("copies")), "doc", dealt=True)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    many = (F.col("copies") > 1) & (F.octet_length("text") >= length)
    # strings of texts that go as a whole still count for others
    once = _spans(texts, length).withColumnRenamed("spans", "found")
    copied = materialize(texts.where(many).select("doc", whole.alias("whole")))
    spans = materialize(once.join(copied, "doc", "full").select("doc", F.coalesce("whole", "found").alias("spans")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), text.alias("text"), doc.alias("doc")).join(spans, "doc", "left")

    @F.arrow_udf("binary")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _kept(texts, spans)

    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    data = F.col("text").cast("binary")
    rows = rows.withColumn("kept", F.when(F.col("spans").isNull(), data).otherwise(kept(data, F.coalesce("spans", none))))
    return rows.select(*(F.col("row")[c].alias(c) for c in others), F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("removed"), "kept")
