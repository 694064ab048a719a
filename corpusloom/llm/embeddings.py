"""Embedding near-dedup: random-hyperplane signatures, exact cosine, connected components.

Equal vectors are first collapsed into one with a multiplicity. Each distinct vector gets a
signature of ``bits`` hyperplane signs in each of several tables; vectors that share a
signature in a table are compared exactly, in double precision, in chunks of bounded size, so a crowded
bucket is many tasks' work and loses nothing. A pair that meets in several tables counts in the first
of them alone, which linked pairs learn from their signatures, computed again; so link counts need no list of
pairs, and a comparison returns counts and a spanning forest, bounded by its size.

Signatures have five bits more than log2(n), so that about one vector in thirty shares a bucket with an unrelated one, and
the number of tables follows from the recall wanted of a pair just at the threshold. Buckets are found on narrow rows,
a key and a name for each vector and table, of which only keys are counted; vectors travel only to buckets with company, and of buckets with the
same members only to that of the first table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import bounded_broadcast, materialize
from .arrow_text import nested_values
from .simhash import spanning_forest

THRESHOLD = 0.95
RECALL = 0.999
SEED = 17
CHUNK = 512
#: Vectors of a bucket that are compared together with other buckets'.
SMALL = 16
#: Groups of a bucket's chunks that meet each other in a grid, as long as a group has no more than so many chunks.
GROUPS, SIDE = 6, 64


def signature_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)`` for n vectors: a pair at the threshold meets in some table with probability recall."""
    bits = min(60, max(8, math.ceil(math.log2(max(n, 2))) + 5))
    meet = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return bits, 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


class Signer:
    """Signatures of unit vectors in every table; the planes of a dimension are drawn once from the seed."""

    def __init__(self, bits: int, tables: int, seed: int = SEED):
        self.bits, self.tables, self.seed, self.planes = bits, tables, seed, {}

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        if dim not in self.planes:
            self.planes[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.bits * self.tables))
        signs = (vectors @ self.planes[dim] >= 0).reshape(len(vectors), self.tables, self.bits)
        return signs @ (1 << np.arange(self.bits, dtype=np.int64))


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within consecutive buckets of the given sizes."""
    starts, left, right = np.cumsum(sizes) - sizes, [], []
    for m in np.unique(sizes):
        i, j = np.triu_indices(m, 1)
        own = starts[sizes == m][:, None]
        left.append((own + i).ravel())
        right.append((own + j).ravel())
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


class _Found:
    """Counts and forest of the links found in one batch."""

    def __init__(self, signer: Signer):
        self.signer, self.parts = signer, []

    def add(self, rep: np.ndarray, mult: np.ndarray, e: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Linked pairs, positions in ``rep``, that met in ``table``; those that meet in an earlier one are left out."""
        for at in range(0, len(left), 1 << 16):
            a, b, t = left[at : at + (1 << 16)], right[at : at + (1 << 16)], table[at : at + (1 << 16)]
            used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            own = self.signer(e[used])
            first = (own[place[: len(a)]] == own[place[len(a) :]]).argmax(axis=1) == t
            self.parts.append((rep[a[first]], mult[b[first]], rep[b[first]], mult[a[first]]))

    def batch(self) -> pa.RecordBatch | None:
        if not sum(len(p[0]) for p in self.parts):
            return None
        a, mb, b, ma = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        reps, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        links = np.bincount(place, np.concatenate((mb, ma)), len(reps)).astype(np.int64)
        root = reps[spanning_forest(place[: len(a)], place[len(a) :], len(reps))]
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(links), pa.array(root)], ["rep", "links", "root"])


def cosine_links(vectors: DataFrame, threshold: float, recall: float, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """From ``vectors(rep, mult, embedding)``, distinct and finite: rows ``(rep, links, root)``; links sum to a vector's
    linked rows, ``(rep, root)`` span its group."""
    bits, tables = signature_plan(vectors.count(), threshold, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bits, tables, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                size = pc.list_value_length(part.column("embedding")).to_numpy()
                for dim in np.unique(size):
                    some = part.filter(pa.array(size == dim))
                    v = nested_values(some.column("embedding")).astype(np.float64).reshape(-1, dim)
                    s = signer(unit(v))
                    offsets = pa.array(np.arange(0, s.size + 1, tables, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([some.column("rep"), pa.array(np.full(len(v), dim, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], ["rep", "dim", "sigs"])

    signed = vectors.select("rep", "embedding").mapInArrow(sign, "rep bigint, dim int, sigs array<bigint>")
    slots = signed.select("rep", F.col("dim"), F.posexplode("sigs").alias("t", "sig"))
    # buckets that share a key by chance are told apart again by table and dimension when their vectors are packed
    slots = materialize(slots.select("rep", "t", F.xxhash64("dim", "t", "sig").alias("key")))
    shared = materialize(slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    slots = materialize(slots.join(bounded_broadcast(shared), "key"))
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    company = slots.groupBy("key", "n").agg(F.min("t").alias("t"), *members)
    crowded = materialize(company.groupBy("n", "m0", "m1").agg(F.min_by("key", F.struct("t", "key")).alias("key")).select("key", F.ceil(F.col("n") / chunk).alias("chunks")))
    rows = slots.drop("n").join(bounded_broadcast(crowded), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks")).join(vectors.select("rep", "mult", F.col("embedding").alias("e")), "rep")
    bucket = ["key", "t", F.size("e").alias("dim"), "chunks"]
    packed = materialize(rows.groupBy(*bucket, "chunk").agg(F.collect_list(F.struct("rep", "mult", "e")).alias("x")))
    fields = lambda s: [F.col(f"x.{k}").alias(f"{k}_{s}") for k in ("rep", "mult", "e")]

    def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
        return unit(nested_values(column).astype(np.float64).reshape(-1, dim))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within buckets of one chunk: small ones all at once, others one by one."""
        signer = Signer(bits, tables, seed)
        for batch in batches:
            found = _Found(signer)
            sizes, dims = pc.list_value_length(batch.column("rep_a")).to_numpy(), batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                for few in (True, False):
                    some = batch.filter(pa.array((dims == dim) & ((sizes <= SMALL) == few)))
                    for part in [some] if few else [some.slice(i, 1) for i in range(some.num_rows)]:
                        if not part.num_rows:
                            continue
                        rep, mult, e = nested_values(part.column("rep_a")), nested_values(part.column("mult_a")), vectors_of(part.column("e_a"), dim)
                        size = pc.list_value_length(part.column("rep_a")).to_numpy().astype(np.int64)
                        table = np.repeat(part.column("t").to_numpy(), size)
                        if few:
                            left, right = pairs_within(size)
                            near = np.concatenate([np.einsum("ij,ij->i", e[left[i : i + 65536]], e[right[i : i + 65536]]) >= threshold for i in range(0, len(left), 65536)])
                            left, right = left[near], right[near]
                        else:
                            left, right = np.nonzero(np.triu(e @ e.T >= threshold, 1))
                        found.add(rep, mult, e, table[left], left, right)
            out = found.batch()
            if out:
                yield out

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two chunks of a bucket, or within one."""
        signer = Signer(bits, tables, seed)
        for batch in batches:
            for i in range(batch.num_rows):
                row, found = batch.slice(i, 1), _Found(signer)
                dim, t, same = (row.column(c)[0].as_py() for c in ("dim", "t", "same"))
                a, b = (vectors_of(row.column(f"e_{s}"), dim) for s in "ab")
                near = a @ b.T >= threshold
                left, right = np.nonzero(np.triu(near, 1) if same else near)
                rep, mult = (np.concatenate([nested_values(row.column(f"{k}_{s}")) for s in "ab"]) for k in ("rep", "mult"))
                found.add(rep, mult, np.concatenate((a, b)), np.full(len(left), t), left, right + len(a))
                out = found.batch()
                if out:
                    yield out

    schema = "rep bigint, links bigint, root bigint"
    ones = packed.where("chunks = 1").select("t", "dim", *fields("a")).mapInArrow(alone, schema)
    # the chunks of a bucket are both sides of a grid, parted into groups: a chunk goes to the cells of its row and its column, which are dealt to a given number of partitions
    many, n = packed.where("chunks > 1"), 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = F.ceil(F.col("chunks") / F.least(F.lit(SIDE), F.ceil(F.col("chunks") / GROUPS)))
    own = F.pmod(F.xxhash64("chunk"), groups)
    every = F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))
    left = many.select("key", own.alias("row"), every.alias("column"), "t", "dim", F.col("chunk").alias("ca"), *fields("a"))
    right = many.select("key", every.alias("row"), own.alias("column"), F.col("t").alias("tb"), F.col("dim").alias("db"), F.col("chunk").alias("cb"), *fields("b"))
    met = left.repartition(n, "key", "row", "column").join(right.repartition(n, "key", "row", "column"), ["key", "row", "column"]).where("t = tb and dim = db and ca <= cb").withColumn("same", F.expr("ca = cb"))
    return ones.union(met.select("t", "dim", "same", *(f"{k}_{s}" for s in "ab" for k in ("rep", "mult", "e"))).mapInArrow(across, schema))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: one row per row of ``vectors``.

    Links: other rows with cosine >= threshold in double precision. Defined cases: vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing and are kept; vectors of different
    length never link; equal vectors link with each other; rows that share an id are separate
    vectors of one component; a null id has null component_id and is kept; extra columns are ignored.
    """
    e = F.col("e")
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x + F.lit(0).cast("float")).alias("e"))
    sound = rows.where(F.coalesce(good, F.lit(False)) & F.col("id").isNotNull())
    distinct = materialize(sound.groupBy("e").agg(F.min("id").alias("rep0"), F.count("*").alias("mult")))
    # an id may stand at several vectors: each distinct vector needs a name of its own
    twice = distinct.groupBy("rep0").agg(F.count("*").alias("n")).where("n > 1")
    named = distinct.join(twice, "rep0", "left").withColumn("rep", F.when(F.col("n").isNull(), F.col("rep0")).otherwise(-1 - F.abs(F.xxhash64("e", "rep0")) % F.lit(1 << 62)))
    named = materialize(named.select("e", "rep0", "rep", "mult"))
    found = materialize(cosine_links(named.select("rep", "mult", F.col("e").alias("embedding")), threshold, recall, seed))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = sound.join(named.select("e", "rep0", "rep", "mult"), "e").select("id", "rep", "rep0", "mult")
    reps = named.select("rep", F.col("rep0").alias("id"))
    edges = found.where("rep <> root").join(reps.withColumnRenamed("id", "src"), "rep").join(reps.select(F.col("rep").alias("root"), F.col("id").alias("dst")), "root").select("src", "dst")
    edges = edges.union(members.where("id <> rep0").join(members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "id").select(F.col("id").alias("src"), F.col("rep0").alias("dst")))
    labels = connected_components(edges).withColumnRenamed("id", "rep0")
    out = members.join(counts, "rep", "left").join(labels, "rep0", "left")
    out = out.select("id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep0").alias("component_id"))
    rest = rows.where(~F.coalesce(good, F.lit(False)) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
