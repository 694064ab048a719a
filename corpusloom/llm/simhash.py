"""SimHash near-dedup by tiled exact comparison of fingerprints.

Fingerprints: XXH64 (seed 42) of every word shingle of the whole text, and per bit the majority.
Distinct fingerprints are sorted into tiles by the bit counts of their segments. Two fingerprints
within ``radius`` bits differ by at most ``radius`` in the sum of their segments' bit
counts, so all other tile pairs are skipped and nothing is lost. A tile pair is compared in
full with exclusive-or and bit counts in numpy; it returns a spanning forest of its links, never the
pairs, so output is bounded by the tiles' sizes. Links meet in distributed components.

Scale: the work per fingerprint is the share of tile pairs that remain. With four segments
of 16 bits about one pair in 60 of random fingerprints is compared, with eight about one in 3000.
Tiles are cut into chunks of bounded size. Each pair of chunks is dealt to a task by itself, in cells of a grid of them, so
a crowded tile is many tasks' work.

Wide fingerprints serve similarity of shingle sets at a threshold (``near_copies.py``): 256 bits over a text's distinct shingles, tiled by
the set's size and the fingerprint's bit count, as sets at the threshold differ little in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import bounded_broadcast, materialize
from .arrow_text import nested_values, text_slices, utf8

SEED = 42
RADIUS = 2
SEGMENTS = 4
CHUNK = 512
#: Cells into which a tile's pairs of chunks are parted, as long as a side of a cell has no more than so many chunks.
CELLS, SIDE = 36, 64
#: Words of 64 bits in a wide fingerprint.
WORDS = 4


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of one UTF-8 text, in order; a shorter text is one shingle; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The 64-bit fingerprint of one UTF-8 text; 0 if it has no words."""
    h = shingle_hashes(text, words_per_shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes (finaliser of SplitMix64)."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` words of majority bits over distinct shingle hashes; zero without any."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        some = shingles[at : at + (1 << 12)]
        ones += np.unpackbits(np.stack([_mixed(some, k) for k in range(words)], axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")


def wide_radius(similarity: float, words: int = WORDS, deviations: float = 3.1) -> int:
    """Bits of ``words`` words within which two sets at the similarity (Jaccard) lie, but for one pair in a thousand.

    Of sets of one size a bit differs with probability arccos(2 s / (1 + s)) / pi; of small sets, where votes tie, with a quarter more.
    """
    p, n = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * words
    return round(n * p + deviations * np.sqrt(n * p * (1 - p)))


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``(id_col, fp)`` for every row; null texts are empty texts with fingerprint 0. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                found = np.array([fingerprint(t or b"", words_per_shingle) for t in utf8(part.column("t")).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found.view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(kernel, f"`{id_col}` {kind}, fp bigint")


def _segment_counts(fp: Column, segments: int) -> list[Column]:
    width = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("long") for i in range(segments)]


def _tile_key(counts: list[Column], base: int, shift: int) -> Column:
    key = F.lit(0).cast("long")
    for c in counts:
        key = key * F.lit(base) + c + F.lit(shift)
    return key


def half_offsets(segments: int, radius: int, base: int) -> list[int]:
    """Differences of tile keys to compare: zero and one of each opposite pair within the radius."""
    found = []
    for d in product(range(-radius, radius + 1), repeat=segments):
        if sum(map(abs, d)) <= radius and d >= (0,) * segments:
            key = 0
            for x in d:
                key = key * base + x
            found.append(key)
    return found


def spanning_forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n nodes reaches over the given links."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into a and b of all fingerprints within the radius; each pair once if same."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if same:
        near = np.triu(near, 1)
    return np.nonzero(near)


def compare_wide_tiles(a: np.ndarray, b: np.ndarray, radius: int, first: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``compare_tiles``, of fingerprints of several words; pairs whose first words differ in more than ``first`` bits are sorted out."""
    left, right = compare_tiles(a[:, 0], b[:, 0], first, same)
    near = np.concatenate([np.bitwise_count(a[left[i : i + 65536]] ^ b[right[i : i + 65536]]).sum(axis=1) <= radius for i in range(0, len(left), 65536)] or [np.zeros(0, bool)])
    return left[near], right[near]


def grid_sides(tiles: DataFrame, offsets: list[int], small: bool) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``tiles(key, chunk, x)`` at the offsets from each tile, and its own chunks, as rows and columns of a grid ``key, row, column``.

    A tile's chunks and the chunks that meet them are the sides of a grid, parted by hash into groups of ``SIDE`` at most, about: a chunk goes to the cells of its row or column, so that some
    ``2 / SIDE`` chunks are shuffled for a pair. small: keys are few whatever the input, and may be broadcast.
    """
    steps = F.explode(F.array(*(F.lit(o).cast("long") for o in offsets))).alias("step")
    probe = tiles.select(steps, "key", F.col("chunk").alias("ca"), F.col("x").alias("a")).withColumn("key", F.col("key") + F.col("step"))
    met = probe.groupBy("key").agg(F.count("*").alias("probes")).join(tiles.groupBy("key").agg(F.count("*").alias("chunks")), "key")
    side = F.least(F.lit(SIDE), F.ceil(F.sqrt(F.col("probes") * F.col("chunks") / CELLS)))
    met = materialize(met.select("key", F.ceil(F.col("probes") / side).alias("rows"), F.ceil(F.col("chunks") / side).alias("columns")))
    met = F.broadcast(met) if small else met
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = probe.join(met, "key").withColumn("row", F.pmod(F.xxhash64("ca", "step"), "rows")).withColumn("column", upto("columns")).drop("rows", "columns")
    right = tiles.join(met, "key").select("key", upto("rows").alias("row"), F.pmod(F.xxhash64("chunk"), "columns").alias("column"), F.col("chunk").alias("cb"), F.col("x").alias("b"))
    return left, right


def dealt_pairs(tiles: DataFrame, offsets: list[int], small: bool) -> DataFrame:
    """Every chunk of ``tiles(key, chunk, x)`` beside each chunk of the tiles at the offsets from its own: ``(a, b, same)``, once each.

    Cells of the grid are dealt to a given number of partitions, which is not coalesced, as little data is much work.
    """
    n, cell = 4 * int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "row", "column"]
    left, right = (side.repartition(n, *cell) for side in grid_sides(tiles, offsets, small))
    return left.join(right, cell).where("step <> 0 or ca <= cb").select("a", "b", F.expr("step = 0 and ca = cb").alias("same"))


def tile_links(pairs: DataFrame, compare, words: int = 1) -> DataFrame:
    """Edges ``(src, dst)`` that span the groups linked by ``compare`` within pairs of chunks ``a, b``, each ``(fps, reps)``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (fa, ra), (fb, rb) = ((nested_values(row.column(f"f{s}")).view(np.uint64), nested_values(row.column(f"r{s}"))) for s in "ab")
                fa, fb = (x.reshape(-1, words) if words > 1 else x for x in (fa, fb))
                same = row.column("same")[0].as_py()
                left, right = compare(fa, fb, same)
                if len(left):
                    ids = np.concatenate((ra, rb))
                    label = spanning_forest(left, right if same else right + len(ra), len(ids))
                    moved = np.flatnonzero(label != np.arange(len(ids)))
                    src.append(ids[moved])
                    dst.append(ids[label[moved]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (src, dst)], ["src", "dst"])

    fields = [F.col(f"{s}.{f}").alias(f"{f[0]}{s}") for s in "ab" for f in ("fps", "reps")]
    return pairs.select(*fields, "same").mapInArrow(kernel, "src bigint, dst bigint")


def packed_tiles(keyed: DataFrame, chunk: int, small: bool) -> DataFrame:
    """``(key, chunk, x struct<fps, reps>)`` of ``keyed(key, fp, rep)``, chunks of about ``chunk`` rows dealt by hash."""
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = keyed.join(F.broadcast(sizes) if small else sizes, "key")
    tiles = dealt.groupBy("key", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk")).agg(F.collect_list(F.struct("fp", "rep")).alias("x"))
    return materialize(tiles.select("key", "chunk", F.struct(F.col("x.fp").alias("fps"), F.col("x.rep").alias("reps")).alias("x")))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(src, dst)`` that span the groups of ``distinct(fp, rep)`` linked within radius."""
    base = 64 // segments + 2 * radius + 1
    # at most (64 / segments + 1) ** segments keys, whatever the input: 83,521 of 16 bytes with four segments
    small = segments <= 4
    tiles = packed_tiles(distinct.select(_tile_key(_segment_counts(F.col("fp"), segments), base, radius).alias("key"), "fp", "rep"), chunk, small)
    return tile_links(dealt_pairs(tiles, half_offsets(segments, radius, base), small), lambda a, b, same: compare_tiles(a, b, radius, same))


#: Bits of a wide fingerprint's count in one tile, and steps of size within the threshold's ratio.
BAND, STEPS = 32, 4


def wide_links(distinct: DataFrame, similarity: float, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(src, dst)`` that span the groups of ``distinct(fp array, n, rep)`` within ``wide_radius``; n: shingles of the set.

    Sets at the similarity differ in size by its ratio at most, so tiles of sizes further apart are skipped, as are those whose bit
    counts differ by more than the radius. Sizes have some 200 steps, bit counts 9 bands: the number of tiles is bounded.
    """
    radius, first, step = wide_radius(similarity, words), wide_radius(similarity, 1, 3.5), float(-np.log(similarity) / STEPS * (1 + 1e-9))
    reach = (radius - 1) // BAND + 1
    bits = F.aggregate("fp", F.lit(0), lambda n, w: n + F.bit_count(w))
    key = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("long") * 64 + F.floor(bits / F.lit(BAND)).cast("long")
    tiles = packed_tiles(distinct.select(key.alias("key"), "fp", "rep"), chunk, True)
    offsets = [size * 64 + band for size in range(STEPS + 1) for band in range(-reach, reach + 1) if size or band >= 0]
    return tile_links(dealt_pairs(tiles, offsets, True), lambda a, b, same: compare_wide_tiles(a, b, radius, first, same), words)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, segments: int = SEGMENTS, words_per_shingle: int = 3) -> DataFrame:
    """``(id_col, fp, component_id)``: one row per row of ``docs``, whole texts, all links within radius.

    Defined cases: null or blank texts have fingerprint 0 and link like any other; rows that share an
    id are fingerprinted apart and linked through the id; rows with a null id keep their fingerprint,
    have a null component and link nothing; an empty table gives an empty result; other columns are ignored.
    Ids are integers.
    """
    prints = materialize(simhash_fingerprints(docs, id_col, text_col, words_per_shingle).withColumnRenamed(id_col, "id"))
    named = prints.where("id is not null")
    distinct = materialize(named.groupBy("fp").agg(F.min("id").cast("long").alias("rep")))
    again = named.select(F.col("id").cast("long").alias("id"), "fp").distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).where("n > 1")
    shared = named.join(again.select("id"), "id").join(distinct, "fp").select(F.col("id").cast("long").alias("src"), F.col("rep").alias("dst"))
    found = connected_components(fingerprint_links(distinct, radius, segments).union(shared.where("src <> dst")))
    labels = distinct.join(found, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(labels, "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row of the smallest ``(id, hash of the text)`` of each group, null ids last; ``groups(node, component)`` of hashes of texts.

    Decisions are made on narrow rows; texts move only if the rows to drop are too many to broadcast. Of rows equal in id and text one stays.
    """
    node = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("i"), node.alias("node")).groupBy("i", "node").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(groups, "node", "left").select("i", "node", "n", F.coalesce("component", "node").alias("g")))
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("i").isNull().alias("last"), "i", "node")).alias("x")).select(F.col("x.i").alias("bi"), F.col("x.node").alias("bn"))
    # by the row's own key, as a group may hold a third of all rows
    rows = rows.join(best, F.col("i").eqNullSafe(F.col("bi")) & (F.col("node") == F.col("bn")), "left")
    rows = materialize(rows.select(F.col("i").alias("__i"), F.col("node").alias("__n"), "n", F.col("bn").isNotNull().alias("stays")))
    # the row's own columns travel as one, so that none can be mistaken for another
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), node.alias("node"))
    this = (F.col("node") == F.col("__n")) & F.col("id").eqNullSafe(F.col("__i"))
    keys = ["__i", "__n"]
    kept = own.join(bounded_broadcast(rows.where("not stays or n > 1").select(*keys)), this, "left_anti")
    repeated = rows.where("stays and n > 1").select(*keys)
    if not repeated.isEmpty():
        kept = kept.union(own.join(bounded_broadcast(repeated), this, "left_semi").dropDuplicates(["id", "node"]))
    return kept.select("row.*")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the smallest id of each group of fingerprints, and all rows with a null id.

    Rows group by their texts alone: of rows that share an id but not a group, one of each group stays.
    """
    named = docs.where(F.col(id_col).isNotNull())
    texts = named.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(F.xxhash64("t").alias("node"), "t")
    groups = simhash_groups(texts, "node", "t", **options).select("node", F.col("component_id").alias("component")).distinct()
    return keep_first(named, groups, id_col, text_col).union(docs.where(F.col(id_col).isNull()))
