"""Near copies by SimHash: candidates from wide fingerprints, decided by the exact Jaccard similarity of word shingles.

The set of a text is XXH64 (seed 42) of its word shingles, its fingerprint 256 bits by the majority of them (``simhash.py``). Tiles of fingerprints
are compared exactly with exclusive-or and bit counts; pairs within ``wide_radius`` are candidates, and a pair of sets at similarity 0.8 is
one with probability 0.999. Unrelated sets are some nine deviations further apart. Candidates are components that are found from spanning
forests, never pairs. Within each component the sets are then compared exactly, and only pairs at the threshold stay linked.

Scale: tile pairs are skipped whose set sizes differ by more than the threshold's ratio, so about one pair in ten of usual texts is compared. That
stays quadratic in distinct texts, as tiled comparison is. In the exact step, large components are cut into tiles of bounded size. All tiles meet
the first one; what is then not in its component's largest group meets all tiles again. A link that the first pass did not imply has
such an end, so nothing is lost, and a large group of near copies costs its size where the first tile
links most of it. It costs its square where it does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import bounded_broadcast, materialize
from .arrow_text import nested_values, text_slices, utf8
from .simhash import keep_first, shingle_hashes, spanning_forest, wide_fingerprint, wide_links

WORDS = 5
THRESHOLD = 0.8
#: Shingles in one tile, about.
TILE = 200_000


def shingle_set(text: bytes, words_per_shingle: int = WORDS) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted; all texts without words have the same one."""
    found = np.unique(shingle_hashes(text, words_per_shingle))
    return found if len(found) else np.zeros(1, np.uint64)


def shared_counts(a: np.ndarray, of_a: np.ndarray, na: int, b: np.ndarray, of_b: np.ndarray, nb: int) -> np.ndarray:
    """Sizes of the intersections of na sets with nb sets, from their hashes and the sets that these belong to."""
    common = np.intersect1d(a, b)
    out = np.zeros((na, nb), np.int64)
    left, right = ((x[k], np.searchsorted(common, h[k])) for h, x in ((a, of_a), (b, of_b)) for k in (np.isin(h, common),))
    left, right = ((x[o], c[o]) for x, c in (left, right) for o in (np.argsort(c, kind="stable"),))
    width = max(256, (1 << 22) // max(na, nb))
    for at in range(0, len(common), width):
        n = min(width, len(common) - at)
        blocks = []
        for (x, c), rows in ((left, na), (right, nb)):
            lo, hi = np.searchsorted(c, (at, at + n))
            block = np.zeros((rows, n), np.float32)
            block[x[lo:hi], c[lo:hi] - at] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def _tiles(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``(component, chunks, chunk, nodes, sizes, sets)`` of ``members(node, component, chunks, chunk)``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                sets = [shingle_set(t or b"", words) for t in utf8(part.column("t")).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "component", "chunks", "chunk")), pa.ListArray.from_arrays(pa.array(ends), values)], ["node", "component", "chunks", "chunk", "hashes"])

    texts = docs.join(bounded_broadcast(members), "node").dropDuplicates(["node"]).select("node", "component", "chunks", "chunk", "t")
    sets = texts.mapInArrow(kernel, "node bigint, component bigint, chunks bigint, chunk bigint, hashes array<bigint>")
    tiles = sets.groupBy("component", "chunks", "chunk").agg(F.collect_list(F.struct("node", "hashes")).alias("x"))
    return materialize(tiles.select("component", "chunks", "chunk", F.col("x.node").alias("nodes"), F.transform("x.hashes", F.size).alias("sizes"), F.flatten("x.hashes").alias("sets")))


def _links(pairs: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(src, dst)`` that span the groups linked at the threshold within pairs of tiles ``na, sa, ha`` and ``nb, sb, hb``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (na, sa, ha), (nb, sb, hb) = (tuple(nested_values(batch.column(c).slice(i, 1)) for c in side) for side in (("na", "sa", "ha"), ("nb", "sb", "hb")))
                shared = shared_counts(ha, np.repeat(np.arange(len(na)), sa), len(na), hb, np.repeat(np.arange(len(nb)), sb), len(nb))
                left, right = np.nonzero(shared >= threshold * (sa.astype(np.int64)[:, None] + sb[None, :] - shared) - 1e-9)
                ids = np.concatenate((na, nb))
                nodes, place = np.unique(ids, return_inverse=True)
                label = spanning_forest(place[left], place[right + len(na)], len(nodes))
                moved = np.flatnonzero(label != np.arange(len(nodes)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["src", "dst"])

    return pairs.mapInArrow(kernel, "src bigint, dst bigint")


def near_copy_groups(docs: DataFrame, text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(node, component)``: one row per distinct text that has near copies; node is ``xxhash64`` of the text, null as empty.

    Two texts are linked if the sets of their shingles have at least the threshold in common (Jaccard); components are what links reach.
    """
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("t")).withColumn("node", F.xxhash64("t"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                sets = [shingle_set(t, words) for t in utf8(part.column("t")).to_pylist()]
                prints = np.stack([wide_fingerprint(s) for s in sets]).view(np.int64)
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * prints.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(prints.reshape(-1)))], ["node", "n", "fp"])

    prints = materialize(texts.select("node", "t").mapInArrow(kernel, "node bigint, n bigint, fp array<bigint>").dropDuplicates(["node"]))
    distinct = materialize(prints.groupBy("fp", "n").agg(F.min("node").alias("rep")))
    equal = prints.join(distinct, ["fp", "n"]).where("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
    found = materialize(connected_components(wide_links(distinct, threshold).union(equal)).withColumnRenamed("id", "node"))
    sized = found.join(prints.select("node", "n"), "node")
    chunks = sized.groupBy("component").agg(F.ceil(F.sum("n") / tile).cast("long").alias("chunks"))
    members = sized.join(chunks, "component").select("node", "component", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    tiles = _tiles(texts, members, words)

    side = lambda x: [F.col("nodes").alias(f"n{x}"), F.col("sizes").alias(f"s{x}"), F.col("sets").alias(f"h{x}")]
    first = tiles.where("chunk = 0").select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), *side("a"))
    links = materialize(_links(first.join(tiles.select("component", "chunk", *side("b")), ["component", "chunk"]), threshold))
    cut = tiles.where("chunks > 1")
    if cut.limit(1).count():
        # what the first tile's links left outside the largest group of its component, in tiles of its own
        groups = connected_components(links)
        own = cut.select("component", F.explode("nodes").alias("id")).join(groups.withColumnRenamed("component", "g"), "id", "left").select("component", "id", F.coalesce("g", "id").alias("g"))
        own = materialize(own)
        largest = own.groupBy("component", "g").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("g", F.struct("c", "g")).alias("g"))
        rest = own.join(largest, ["component", "g"], "left_anti").select("component", F.col("id").alias("node"))
        again = _tiles(texts, members.join(rest.select("node"), "node", "left_semi"), words)
        wide = again.select("component", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"), *side("a"))
        right = cut.select("component", F.col("chunk").alias("other"), *side("b"))
        links = links.union(materialize(_links(wide.join(right, ["component", "other"]), threshold)))
    return connected_components(links).withColumnRenamed("id", "node")


def near_copy_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest ``(id, hash of the text)``.

    Defined cases: rows group by their texts alone, so rows of one id with unrelated texts all stay; null ids take part and come last;
    null and blank texts are copies of each other; of rows equal in id and text one stays; an empty table gives an empty result; other
    columns are ignored.
    """
    return keep_first(docs, near_copy_groups(docs, text_col, **options), id_col, text_col)
