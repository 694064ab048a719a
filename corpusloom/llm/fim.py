"""Fill-in-middle: documents cut in three by a seeded draw and put together again with the middle last.

Cuts count code points, texts are held as UTF-8. An index holds each distinct text once, with the byte offsets of its code points as an Elias-Fano list (Elias 1974, Fano 1971);
documents are joined back to it by digest, and a cut is one select in the list of its text. Texts move once: the index is grouped by the digest, texts of
a group are compared as they are collected, and the last join finds them where that shuffle put them; otherwise lists, ids and offsets travel.

A text that many documents share is no hot key: texts of more than a thousandth of all rows, a thousand at most, are dealt in that many parts, each of a thousandth of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.materialize import materialize

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Groups of more than one part in so many of all rows are dealt to several tasks, but no group below ``LEAST_HOT``.
PARTS, LEAST_HOT = 1000, 64
#: Bits of the upper half between two counts that are stored with it.
SAMPLED_BITS = 4096


def elias_fano(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """``(low_bits, low, high, counts)`` of rising values below ``universe``.

    The low bits of all values stand in planes, the high bits in unary: value i sets bit (value >> low_bits) + i. ``counts`` are the bits set before every
    ``SAMPLED_BITS`` bits.
    """
    n = len(values)
    low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
    low = b"".join(np.packbits((values >> j) & 1 == 1, bitorder="little").tobytes() for j in range(low_bits))
    bits = np.zeros(-(-((universe >> low_bits) + n + 1) // SAMPLED_BITS) * SAMPLED_BITS, bool)
    bits[(values >> low_bits) + np.arange(n, dtype=values.dtype)] = True
    ahead = np.cumsum(bits.reshape(-1, SAMPLED_BITS).sum(axis=1)) if len(bits) else np.zeros(1, int)
    counts = np.concatenate([[0], ahead[:-1]]).astype("<u4")
    return low_bits, low, np.packbits(bits, bitorder="little").tobytes(), counts.tobytes()


def select(low_bits: int, n: int, low: bytes, high: bytes, counts: bytes, at: int) -> int:
    """The value at place ``at`` of the n values of an Elias-Fano list."""
    ahead = np.frombuffer(counts, "<u4")
    block = int(np.searchsorted(ahead, at, side="right")) - 1
    width = SAMPLED_BITS // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8, width, block * width), bitorder="little"))
    value = (block * SAMPLED_BITS + int(ones[at - int(ahead[block])]) - at) << low_bits
    plane = -(-n // 8)
    for j in range(low_bits):
        value |= (low[j * plane + at // 8] >> (at % 8) & 1) << j
    return value


_LIST = pa.struct([("n", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])
_LIST_SQL = "n bigint, low_bits int, low binary, high binary, counts binary"


def _boundaries(texts: pa.Array) -> pa.Array:
    """Of each text, the bytes at which its n code points begin, and where the last one ends."""
    rows = []
    for text in texts:
        data = np.frombuffer(text.as_buffer() or b"", np.uint8)
        kind = np.int32 if len(data) < 1 << 30 else np.int64
        starts = np.append(np.flatnonzero((data & 0xC0) != 0x80).astype(kind), np.array([len(data)], kind))
        low_bits, low, high, counts = elias_fano(starts, len(data) + 1)
        rows.append((len(starts) - 1, low_bits, low, high, counts))
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _LIST)], fields=list(_LIST))


def _cut(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """The byte offsets of two boundaries of each list."""
    n, low_bits, low, high, counts = (lists.field(i) for i in range(5))
    a, b = first.to_numpy(zero_copy_only=False), last.to_numpy(zero_copy_only=False)
    out = np.zeros((2, len(lists)), np.int64)
    for i in range(len(lists)):
        parts = (low_bits[i].as_py(), n[i].as_py() + 1, low[i].as_buffer(), high[i].as_buffer(), counts[i].as_buffer())
        out[0, i], out[1, i] = select(*parts, int(a[i])), select(*parts, int(b[i]))
    return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["first", "last"])


def text_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``rows(key, part, text)``: ``texts(key, part, text)`` with every text once for a part, and ``lists(key, part, cuts)``, its Elias-Fano list.

    Texts are compared as they are collected: two of one digest raise an error. Both tables read one shuffle of the texts, which stay where it put them.
    """

    @F.arrow_udf(f"struct<{_LIST_SQL.replace(' ', ':').replace(',:', ',')}>")
    def boundaries(texts: pa.Array) -> pa.Array:
        return _boundaries(texts.cast(pa.binary()))

    groups = rows.groupBy("key", "part").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("two texts have one digest")).cast("string"))
    texts = groups.select("key", "part", one.alias("text"))
    return texts, texts.select("key", "part", boundaries("text").alias("cuts"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``part``: 0, or by the hash of the whole row where more rows than a part in ``PARTS`` have one key."""
    seen = Observation()
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total")).where(F.col("n") > LEAST_HOT)
    crowded = materialize(crowded)
    share = max(LEAST_HOT, (seen.get["total"] or 0) // PARTS)
    hot = crowded.where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("id", "row"), F.col("parts")), F.lit(0).cast("long"))
    return rows.join(F.broadcast(hot), "key", "left").withColumn("part", part).drop("parts")  # PARTS rows at most


def draws(identifier: Column, seed: int, count: int = 4) -> list[Column]:
    """``count`` numbers of 32 bits from the hex digits of a digest of seed and identifier; a null identifier counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part behind its mark. Texts that hold a mark stay plain.
    Null texts are empty, and empty texts plain; a null id draws as an empty one; rows of equal id are cut alike if their texts are; an empty table gives an empty result; columns
    named as a result are replaced, all others stay. Rows that are equal in every column share a task.
    """
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    others = [c for c in docs.columns if c not in results and c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.struct(F.col(text_col).isNull().alias("none"), *(F.col(c) for c in others)).alias("row"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    rows = _dealt(rows)
    texts, lists = text_index(rows.select("key", "part", "text"))

    @F.arrow_udf("struct<first:bigint,last:bigint>")
    def cut(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        return _cut(lists, first, last)

    h1, h2, h3, h4 = draws(F.col("id"), seed)
    units = F.col("cuts.n") + 1
    drawn = rows.select("id", "row", "key", "part").join(lists, ["key", "part"])
    drawn = drawn.select("row", "key", "part", "cuts", F.least(h1 % units, h2 % units).alias("first"), F.greatest(h1 % units, h2 % units).alias("last"), (h3 % 100 >= 100 - plain_percent).alias("left"), (h4 % 100 < suffix_first_percent).alias("spm"))
    drawn = drawn.withColumn("at", cut("cuts", "first", "last")).withColumn("n", F.col("cuts.n")).drop("cuts")
    at = drawn.join(texts, ["key", "part"])
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    at = at.withColumn("form", F.when((F.col("text") == "") | marked | F.col("left"), "plain").when(F.col("spm"), "spm").otherwise("psm"))
    data, x, y = F.col("text").cast("binary"), F.col("at.first").cast("int"), F.col("at.last").cast("int")
    prefix, middle, suffix = (F.substring(data, a, b).cast("string") for a, b in ((F.lit(1), x), (x + 1, y - x), (y + 1, F.octet_length("text") - y)))
    put = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    put = put.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    cut_up = F.col("form") != "plain"
    back = {text_col: F.when(~F.col("row.none"), F.col("text"))} | {c: F.col(f"row.`{c}`") for c in others}
    return at.select(
        *(back[c].alias(c) for c in docs.columns if c in back), "n", "form", F.when(cut_up, F.col("first")).alias("prefix_chars"),
        F.when(cut_up, F.col("last") - F.col("first")).alias("middle_chars"), put.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its parts lie between the marks, which no text that was cut holds."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
