"""Sharding along a Hilbert curve over several metadata dimensions.

Dimensions are quantised to ``bits`` bits each, by the quantiles of all rows, so that a cell's halves hold about as many rows and
values keep their order; rows are ordered by their index on the curve, and the order is
cut into runs of equal counts. Neighbours on the curve are neighbours in every dimension, so each run covers a small
range of each and files can be skipped by any of them. The index is computed bit by bit with the curve's
automaton (Hamilton 2006, "Compact Hilbert indices"): a state is an entry corner and a direction, and a
table derived from those rules maps state and corner to the next state and a digit. DataFrame functions only.

The global order is a range partitioning of narrow rows, written once: a row's rank is its place in its
range plus the rows of the ranges before, a table of one row per partition. A hot value of all
dimensions is split by a hash of the id, which is part of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..plans.order import running_sum

SHARDS = 8
BITS = 8


def curve_table(dims: int) -> list[tuple[int, int]]:
    """``(digit, next state)`` by state * 2**dims + corner; a state is entry * dims + direction."""
    size, top = 1 << dims, dims
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(size)}
    turn = lambda x, k: ((x << k % top) | (x >> (top - k % top))) & (size - 1) if k % top else x

    def entry(w: int) -> int:
        return 0 if w == 0 else gray(2 * ((w - 1) // 2))

    def ones(i: int) -> int:
        """Trailing one bits of i: the dimension in which corners i and i + 1 differ."""
        n = 0
        while i >> n & 1:
            n += 1
        return n

    def inner(w: int) -> int:
        return 0 if w == 0 else ones(w - 1) % dims if w % 2 == 0 else ones(w) % dims

    out = []
    for state in range(size * dims):
        e, d = divmod(state, dims)
        for corner in range(size):
            w = rank[turn(corner ^ e, top - (d + 1))]
            out.append((w, (e ^ turn(entry(w), d + 1)) * dims + (d + inner(w) + 1) % dims))
    return out


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """The index of a cell, each coordinate an integer below 2**bits."""
    dims, table = len(cells), curve_table(len(cells))
    digits, states = (F.array(*(F.lit(row[i]) for row in table)) for i in (0, 1))

    def step(acc: Column, bit: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(cells):
            corner = corner.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", c.cast("int"), bit).bitwiseAND(F.lit(1)), F.lit(j)))
        at = acc["s"] * F.lit(1 << dims) + corner
        return F.struct((acc["h"] * F.lit(1 << dims) + F.get(digits, at)).alias("h"), F.get(states, at).alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["h"])


def by_size(value: Column, bits: int = BITS) -> Column:
    """A count's cell on a logarithmic scale, 2**bits cells up to 2**32; 0 for null and negative values."""
    top = (1 << bits) - 1
    return F.least(F.lit(top), F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)).cast("double"), F.lit(0.0)) + 1) * F.lit((top + 1) / 32))).cast("int")


def quantiles(rows: DataFrame, column: str, bits: int = BITS) -> list:
    """The values at the places n * i / 2**bits of the sorted column, i from 1; none of nulls. Numbers or texts, counted by value first."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = materialize(running_sum(counts, "n", F.col("v"), name="upto"))
    total = placed.agg(F.max("upto")).first()[0] or 0
    cut = lambda c: F.ceil(c * F.lit(1 << bits) / F.lit(total or 1))
    low, high = F.greatest(cut(F.col("upto") - F.col("n")), F.lit(1)), F.least(cut(F.col("upto")) - 1, F.lit((1 << bits) - 1))
    found = placed.where(low <= high).select(F.explode(F.sequence(low, high)).alias("i"), "v").collect()  # 2**bits rows at most
    return [r["v"] for r in sorted(found, key=lambda r: r["i"])]


def by_quantile(value: Column, bounds: list, bits: int = BITS) -> Column:
    """A value's cell: how many of the sorted bounds lie below it, by bisection; 0 for null."""
    if len(bounds) < (1 << bits) - 1:
        return F.lit(0)
    table = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(bits))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) < value, step).otherwise(0)), F.lit(0))


def document_cells(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> list[Column]:
    """Source, language and length of documents as cells of about as many rows each; a missing column is cell 0."""
    facts = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")} | {"length": F.octet_length(F.col(text_col))}
    rows = materialize(docs.select(*(v.alias(k) for k, v in facts.items())))
    return [by_quantile(v, quantiles(rows, k, bits), bits) for k, v in facts.items()]


def curve_ranks(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__rank``, their 0-based place in the order, without a pass over all rows in one task.

    Rows equal in the whole order may take each other's place. The ranges are written once, as their bounds are sampled.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows)
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    ahead = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    ranked = sorted_rows.withColumn("__part", part).join(F.broadcast(ahead), "__part")  # one row per partition
    return ranked.withColumn("__rank", F.col("__ahead") + place).drop("__part", "__at", "__ahead")


def even_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """``ranked(__rank)`` with ``shard`` and ``slot``: runs of counts at most one apart, gapless places within them."""
    total = ranked.count()
    base, more = divmod(total, shards)
    cut, rank = more * (base + 1), F.col("__rank")
    shard = F.when(rank < cut, F.floor(rank / F.lit(base + 1))).otherwise(F.lit(more) + F.floor((rank - cut) / F.lit(max(base, 1)))).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * F.lit(base + 1)).otherwise(F.lit(cut) + (F.col("shard") - more) * F.lit(base))
    return ranked.withColumn("shard", shard).withColumn("slot", (rank - start).cast("long"))


#: Columns of a row's place beside its id.
PLACE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", cells: list[Column] | None = None, bits: int = BITS, carry: bool = False) -> DataFrame:
    """``(id_col, size, text_crc32, law, shard, slot, grown_shard, hilbert)``: every row's place.

    Texts are not shuffled, unless ``carry`` asks for all columns of ``docs`` beside the place, in curve order.
    Law ``rows``: counts of shards are at most one apart. Defined cases: a null text has size 1 and a null checksum, an
    empty one size 1 and checksum 0; null metadata are cell 0; null ids come first within a cell's hash order;
    equal rows take neighbouring slots; with fewer rows than shards the last shards are empty; of carried columns those
    with a name of the result are replaced by it, all others stay as they are.
    """
    cells = cells or document_cells(docs, text_col, bits)
    text = F.col(text_col)
    carried = [c for c in docs.columns if carry and c != id_col and c not in PLACE]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_index(cells, bits).alias("hilbert"), F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")).alias("__tie"),
        F.struct(*(F.col(f"`{c}`") for c in carried), F.lit(0).alias("__end")).alias("__row"),
    )
    ranked = curve_ranks(rows, ["hilbert", "__tie", "__id", "size", "text_crc32"])
    out = even_runs(ranked, shards).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select(F.col("__id").alias(id_col), *(F.col("__row")[c].alias(c) for c in carried), *PLACE)


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", files_per_shard: int = 16) -> None:
    """Write ``docs`` in curve order below ``path``, a folder per shard with files of consecutive slots.

    Defined cases: ids are unique and not null, as rows find their place by them: rows without a place are left out, an id that is repeated
    takes each of its places; columns of ``docs`` named as a place's are replaced; an empty table writes no files.
    """
    place = ["shard", "slot", "hilbert"]
    kept = [c for c in docs.columns if c not in place]
    ends = placed.groupBy("shard").agg((F.max("slot") + 1).alias("n"))  # a row per shard
    places = placed.select(F.col(f"`{id_col}`").alias("id"), *place).join(F.broadcast(ends), "shard").withColumn("file", F.floor(F.col("slot") * files_per_shard / F.col("n")))
    # a row's own columns travel as one, so that none can be mistaken for another
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")).join(places, "id")
    rows = rows.repartitionByRange("shard", "file").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col("row")[c].alias(c) for c in kept), *place).write.partitionBy("shard").parquet(path)


def shard_ranges(docs: DataFrame, placed: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row per shard with the least and greatest value of each column, for skipping shards.

    Defined cases: nulls count as rows but not in the ranges, a shard of nulls alone has null ends; ids as in ``write_shards``; an empty
    table gives no rows.
    """
    ends = [f(f"`{c}`").alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return docs.select(id_col, *(F.col(f"`{c}`") for c in columns)).join(placed.select(id_col, F.col("shard").alias("__shard")), id_col).groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n"), *ends)
