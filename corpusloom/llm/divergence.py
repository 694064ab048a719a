"""How the words of each source differ from those of the other sources of its language, in whole numbers.

Terms become integers in the order of their UTF-8 bytes: the terms of a language that enough of its documents hold are ordered once by ranges, and a run of them with the counts of
all sources is a chunk of bounded size. In its task a chunk is a sorted array; its rows find their ids by ``searchsorted``, ``bincount`` makes one dense vector for each source, and
all values follow from these vectors. Ids keep the order of terms, so that ties need no comparison of strings.

Texts are read once, and what is shuffled are counts: a term, source and language make one row for each batch that holds them. No vocabulary is held as a whole anywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import bounded_broadcast, materialize
from ..plans.order import with_group_position
from .arrow_text import text_slices, utf8

#: Sources times terms of a chunk.
CELLS = 1 << 15
#: Terms that a task counts before it hands them on, and bytes of a text that it splits at a time.
COUNTED, PIECE = 200_000, 1 << 20
SCALE_STEPS = 3  # of a thousand each: shares count billionths

#: Letters and all bytes of longer characters stay, A-Z lower-cased; all else parts terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(_TERMS)
        while end < len(text) and not piece.endswith(b" "):  # a term is never split, however long
            more = text[end : end + PIECE].translate(_TERMS)
            gap = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:gap], end + gap
        yield piece.split()
        at = end


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term, and a row of the empty term for every group. Nulls are empty."""
    schema = "lang string, source string, term binary, n bigint, docs bigint"

    def emit(counted: dict) -> pa.RecordBatch:
        rows = [(*group, t, n, found[t]) for group, (total, found) in counted.items() for t, n in total.items()]
        columns = zip(*rows) if rows else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, held = {}, 0
        for batch in batches:
            for part in text_slices(batch, "t"):
                for lang, source, text in zip(part.column("l").to_pylist(), part.column("s").to_pylist(), utf8(part.column("t"))):
                    total, found = counted.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                    before, own = len(total), set()
                    for terms in terms_of(text.as_py()):
                        total.update(terms)
                        own.update(terms)
                    found.update(own)
                    found[b""] += 1
                    held += len(total) - before
                    if held > COUNTED:
                        yield emit(counted)
                        counted, held = {}, 0
        yield emit(counted)

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = docs.select(empty(lang_col).alias("l"), empty(source_col).alias("s"), empty(text_col).alias("t")).mapInArrow(kernel, schema)
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (counts + 1) / (total + terms))`` by long division; exact while the divisor is below 9 * 10**15."""
    divisor = np.asarray(total, np.int64) + terms
    share, rest = np.divmod(counts + 1, divisor)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, divisor)
        share = share * 1000 + digit
    return share + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q) ** 2 / q)``; shares are below 2 ** 31, so squares fit."""
    return (p - q) ** 2 // q


def compare_chunk(sources: list[str], totals: np.ndarray, vocabulary: int, base: int, src: list[str], terms: list[bytes], n: np.ndarray, top: int) -> tuple[list, list]:
    """Of one chunk: ``(source, other, value)`` of every two sources, and ``(source, term, id, value)`` of the first ``top`` of each source.

    Counts are exact below 2 ** 53.
    """
    names = np.array(sources, object)
    order = np.argsort(names)
    names, totals = names[order], totals[order]
    kept = np.unique(np.array(terms + [b""], object))[1:]
    pairs, best = [], []
    cells = np.searchsorted(names, np.array(src, object)) * len(kept) + np.searchsorted(kept, np.array(terms, object)) if len(kept) else np.zeros(0, np.int64)
    counts = np.bincount(cells.astype(np.int64), weights=n, minlength=len(names) * len(kept)).astype(np.int64).reshape(len(names), len(kept))
    p = shares(counts, totals[:, None], vocabulary) if len(kept) else counts
    q = shares(counts.sum(axis=0), int(totals.sum()), vocabulary) if len(kept) else counts
    for i, name in enumerate(names):
        value = divergence(p[i], p).sum(axis=1)
        pairs += [(name, names[j], int(value[j])) for j in range(len(names)) if j != i]
        if len(kept):
            mine = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            gap = divergence(p[i, mine], q[mine])
            first = np.lexsort((mine, -gap))[:top]
            best += [(name, kept[k], base + int(k), int(g)) for k, g in zip(mine[first], gap[first])]
    return pairs, best


def divergence_audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of a language.

    Part ``pair`` has each other source of the language, by falling divergence over all kept terms, those in ``min_docs`` documents of the language at least;
    part ``term`` the first ``top`` kept terms that the source uses more than its language does. Ties go by the bytes of the item.
    Null texts, languages and sources are empty strings; sources without terms take part, a language without kept terms has pairs of value 0; rows count one by one, also
    repeated ones; an empty table gives an empty result. Only the three columns are read, whatever others are called.
    """
    counts = materialize(term_counts(docs, text_col, lang_col, source_col))
    named, groups = counts.where(F.octet_length("term") > 0), counts.where(F.octet_length("term") == 0).select("lang", "source")
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.count("*"))).cast("long").alias("width"))
    kept = named.groupBy("lang", "term").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs).select("lang", "term")
    kept = with_group_position(kept, "lang", F.col("term"), name="id").join(bounded_broadcast(langs), "lang")
    kept = materialize(kept.select("lang", "term", F.floor(F.col("id") / F.col("width")).alias("chunk"), "width"))
    encoded = materialize(named.join(kept, ["lang", "term"]).select("lang", "chunk", "source", "term", "n"))
    totals = groups.join(encoded.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    chunks = kept.groupBy("lang", "chunk").agg(F.count("*").alias("v"), F.max("width").alias("width"))
    sizes = langs.join(chunks.groupBy("lang").agg(F.sum("v").alias("v")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"))
    chunks = sizes.join(chunks.drop("v"), "lang", "left").select("lang", "v", F.coalesce("chunk", F.lit(0)).alias("chunk"), (F.coalesce("chunk", F.lit(0)) * F.coalesce("width", F.lit(0))).alias("base"))
    heads = chunks.join(totals, "lang").select("lang", "chunk", "source", F.lit(None).cast("binary").alias("term"), "n", "v", "base")
    none = F.lit(None).cast("bigint")
    rows = heads.union(encoded.select("lang", "chunk", "source", "term", "n", none, none))
    schema = "part string, lang string, source string, item binary, id bigint, value bigint"

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        head = table.filter(pc.is_null(table.column("term")))
        body = table.filter(pc.is_valid(table.column("term")))
        pairs, best = compare_chunk(
            head.column("source").to_pylist(), head.column("n").to_numpy(), head.column("v")[0].as_py(), head.column("base")[0].as_py(),
            body.column("source").to_pylist(), body.column("term").to_pylist(), body.column("n").to_numpy(), top,
        )
        lang = key[0].as_py()
        out = [("pair", lang, a, b.encode(), 0, v) for a, b, v in pairs] + [("term", lang, a, t, i, v) for a, t, i, v in best]
        columns = zip(*out) if out else [[]] * 6
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "lang", "source", "item", "id", "value"])

    found = materialize(rows.groupBy("lang", "chunk").applyInArrow(kernel, schema))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    own = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item")))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    return pairs.unionByName(best.drop("id")).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
