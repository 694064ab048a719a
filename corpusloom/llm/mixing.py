"""Mixing sources to target weights with hierarchical budgets.

Leaves of a tree, for instance domain, language, source, have documents. A budget of tokens goes down the tree
by weight. Where a child has fewer tokens than its share, the rest goes to its siblings by their weights,
and only what no sibling can take stays with the ancestors' other children: at each level the share of a child is
min(capacity, level * weight), with the level that spends the whole budget, found in closed form by windows over the
aggregated tree. Each leaf then takes a prefix of its seeded epochs: whole passes over its documents, and
in the last pass documents in the order of a seeded hash, the last one cut to the tokens that are left.

Prefixes need no ordered pass over a leaf: hash ranges of bounded size are summed first, and rows are
ordered only within the range where the budget ends. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import bounded_broadcast, materialize

SEED = 7
#: Documents in one hash range of a leaf, about.
RANGE_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def count_tokens(text: Column) -> Column:
    """Words, parted by the ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(rf"(?s)[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(words, 1, F.greatest(n, F.lit(0)).cast("int")), "")


def seeded_order(seed: Column, epoch: Column, key: Column) -> Column:
    """A hash of 60 bits, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", seed.cast("string"), epoch.cast("string"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def share_budget(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``nodes(parent..., child, weight, capacity, budget)`` with ``share``: budget is the parent's, shares are whole tokens.

    A child without weight gets nothing. Shares are rounded down; what rounding leaves goes to the first children with room.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("fill"), F.col(child))
    live = nodes.withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(-1.0)))
    live = live.withColumn("room", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast("long"))
    live = live.withColumn("spent", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    live = live.withColumn("left", F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # in order of capacity / weight, the first child that does not fill sets the level; those after it come out lower
    live = live.withColumn("level", F.when((F.col("left") > 0) & (F.col("weight") > 0), (F.col("budget") - F.col("spent")) / F.col("left")))
    live = live.withColumn("final", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(group))
    share = F.least(F.col("room").cast("double"), F.floor(F.coalesce(F.col("final") * F.col("weight"), F.col("room").cast("double")) + 1e-6)).cast("long")
    live = live.withColumn("share", F.when(F.col("weight") > 0, F.greatest(share, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")))
    ahead = group.orderBy(F.col(child)).rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("due", F.least(F.col("budget"), F.sum("room").over(group)) - F.sum("share").over(group))
    live = live.withColumn("before", F.coalesce(F.sum(F.col("room") - F.col("share")).over(ahead), F.lit(0)))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("room") - F.col("share"), F.col("due") - F.col("before")))
    return live.withColumn("share", (F.col("share") + extra).cast("long")).select(*nodes.columns, "share")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[Column], budget: int, epochs: int) -> DataFrame:
    """``leaves(levels..., tokens)`` with ``budget``: the tokens each leaf gives, by way of every level of the tree.

    weights: for each level an expression over its column and those above it, the weight among siblings.
    """
    base = leaves.select(*levels, "tokens", (F.col("tokens") * epochs).cast("long").alias("capacity"))
    above: DataFrame | None = None
    for depth, weight in enumerate(weights, 1):
        own, parent = levels[:depth], levels[: depth - 1]
        nodes = base.groupBy(*own).agg(F.sum("capacity").cast("long").alias("capacity")).withColumn("weight", F.coalesce(weight.cast("double"), F.lit(0.0)))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if above is None else nodes.join(above, parent)
        above = share_budget(nodes, parent, levels[depth - 1]).select(*own, F.col("share").alias("budget"))
    return base.select(*levels, "tokens").join(above, levels)


def _leaf_plan(docs: DataFrame, levels: dict[str, Column], weights: list[Column], fraction: float, epochs: int, id_col: str, text_col: str, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows(id, levels..., tokens, text_hash)`` with words, and of each leaf ``passes, rest, ranges``: whole passes, tokens of the last one, hash ranges."""
    names = list(levels)
    rows = docs.select(F.col(id_col).alias("id"), *(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()), count_tokens(F.col(text_col)).alias("tokens"), F.xxhash64(text_col).alias("text_hash"))
    rows = materialize(rows.where("tokens > 0"))
    leaves = rows.groupBy(*names).agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("n"))
    leaves = materialize(leaves)
    amount = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * fraction)  # one number
    plan = leaf_budgets(leaves, names, weights, amount, epochs).join(leaves.select(*names, "n"), names)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    plan = materialize(plan.withColumn("ranges", F.ceil(F.col("n") / range_rows)).select(*names, "passes", "rest", "ranges"))
    return rows, plan


def _last_pass(planned: DataFrame, names: list[str], seed: int) -> DataFrame:
    """The rows that the last pass of their leaf takes, with ``h``, their place in its order, and ``tokens_taken``."""
    last = planned.where("rest > 0").withColumn("h", seeded_order(F.lit(seed), F.col("passes"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    last = last.withColumn("range", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.col("ranges")).cast("long"))
    sums = last.groupBy(*names, "range").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "range", F.coalesce(F.sum("s").over(before), F.lit(0)).cast("long").alias("ahead"), "s")
    last = last.join(sums, [*names, "range"]).where("ahead < rest")
    full = last.where("ahead + s <= rest").withColumn("tokens_taken", F.col("tokens"))
    within = Window.partitionBy(*names, "range").orderBy("h", "id", "tokens", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.where("ahead + s > rest").withColumn("at", F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    edge = edge.where("at < rest").withColumn("tokens_taken", F.least(F.col("tokens"), F.col("rest") - F.col("at")))
    shape = ["id", "text_hash", *names, "passes", "h", "tokens", F.col("tokens_taken").cast("long").alias("tokens_taken")]
    return full.select(*shape).union(edge.select(*shape))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: list[Column], fraction: float, epochs: int = 1, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``(id_col, levels..., epoch, tokens, tokens_taken)``, and ``text_hash``: what each document gives to a mixture of ``fraction`` of all tokens.

    levels: names and expressions, from the root's children down to the leaves; weights: for each level
    an expression over these names. A document appears once for each of its
    leaf's epochs that takes it. Defined cases: null level values are the leaf ``unknown``; documents without words are never taken;
    a null id is ordered as the empty text; rows of equal ids in a leaf are ordered by size, equal rows stand
    together; a budget above what all weighted leaves hold takes all of it; an empty table gives an empty result.
    """
    names = list(levels)
    rows, plan = _leaf_plan(docs, levels, weights, fraction, epochs, id_col, text_col, range_rows)
    planned = rows.join(plan, names)
    whole = planned.where("passes > 0").select("id", "text_hash", *names, F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("epoch"), "tokens", F.col("tokens").alias("tokens_taken"))
    last = _last_pass(planned, names, seed)
    shape = ["id", "text_hash", *names, F.col("passes").alias("epoch"), "tokens", "tokens_taken"]
    return whole.union(last.select(*shape)).withColumnRenamed("id", id_col)


def take_mixture(docs: DataFrame, mixture: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a mixture with all their columns, once for each time that they are taken, texts cut to ``tokens_taken``.

    Defined cases: rows equal in id and text are taken as often as the mixture takes them, with the other columns of one of them; a null id
    meets the null ids of the mixture; null texts are never taken; a mixture that takes nothing, or an empty table, gives an empty result; columns stay as they are, whatever their names.
    """
    takes = mixture.groupBy(F.col(f"`{id_col}`").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("tokens", "tokens_taken")).alias("takes"))
    # a row's own columns travel as one, so that none can be mistaken for another
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("own"), F.xxhash64(f"`{text_col}`").alias("text_hash"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    once = keyed.join(takes, same).dropDuplicates(["own", "text_hash"]).select("row", F.explode("takes").alias("take"))
    t = F.col("row")[text_col]
    text = F.when(F.col("take.tokens_taken") < F.col("take.tokens"), cut_tokens(t, F.col("take.tokens_taken"))).otherwise(t)
    return once.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def mix_documents(
    docs: DataFrame, levels: dict[str, Column], weights: list[Column], fraction: float, epochs: int = 1, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The documents of ``mix`` with all their columns, as ``take_mixture`` gives them, without a shuffle of texts.

    The last pass of a leaf takes a prefix of its order, so its last row alone, one for each leaf, tells every document whether it is taken.
    Defined cases: those of ``mix``; of rows equal to a leaf's last row as many stay as the mixture takes, with the other columns of one of them.
    """
    names = list(levels)
    rows, plan = _leaf_plan(docs, levels, weights, fraction, epochs, id_col, text_col, range_rows)
    last = materialize(_last_pass(rows.join(plan, names), names, seed))
    order = F.struct("h", "id", "tokens", "text_hash")
    ends = last.groupBy(*names).agg(F.max(order).alias("end"), F.max_by("tokens_taken", F.struct(order, -F.col("tokens_taken"))).alias("cut"))
    ends = materialize(plan.join(ends, names, "left").select(*names, "passes", "end", "cut"))
    # how many rows equal a leaf's last row, and how many of them are taken whole
    same = F.col("id").eqNullSafe(F.col("end.id")) & (F.col("tokens") == F.col("end.tokens")) & (F.col("text_hash") == F.col("end.text_hash"))
    equal = rows.join(bounded_broadcast(ends), names).where(same).groupBy(*names).agg(F.count("*").alias("equal"))
    taken = last.join(bounded_broadcast(ends.select(*names, "end")), names).where(same).groupBy(*names).agg(F.count_if(F.col("tokens_taken") == F.col("tokens")).alias("full"))
    ends = ends.join(equal, names, "left").join(taken, names, "left")
    ends = materialize(ends.select(F.struct(*names).alias("__leaf"), F.struct("passes", "end", "cut", "equal", "full").alias("__p")))
    leaf = F.struct(*(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in levels.items()))
    # a row's own columns travel as one, so that none can be mistaken for another
    own = docs.where(F.col(f"`{text_col}`").rlike(WORD)).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t"), leaf.alias("__leaf"))
    own = own.join(bounded_broadcast(ends), "__leaf")
    end, key, t = F.col("__p.end"), F.col("id"), F.col("t")
    head = F.struct(seeded_order(F.lit(seed), F.col("__p.passes"), F.coalesce(key.cast("string"), F.lit(""))).alias("h"), key.alias("id"))
    tail = F.struct(count_tokens(t).alias("tokens"), F.xxhash64(t).alias("text_hash"))
    end_head, end_tail = F.struct(end["h"], end["id"]), F.struct(end["tokens"], end["text_hash"])
    # words are counted again only where hash and id are those of the last row
    at = F.when(end.isNull() | (head > end_head), 1).when(head < end_head, -1).when(tail > end_tail, 1).when(tail < end_tail, -1).otherwise(0)
    placed = own.withColumn("__at", at)
    text = F.when((F.col("__at") == 0) & (F.col("__p.cut") < F.col("__p.end.tokens")), cut_tokens(t, F.col("__p.cut").cast("int"))).otherwise(t)
    # takes: one for each whole pass, and in the last pass one for rows up to the last one
    once = F.when(F.col("__at") < 0, F.array(t)).when((F.col("__at") == 0) & (F.col("__p.equal") == 1), F.array(text)).otherwise(F.array().cast("array<string>"))
    takes = F.concat(F.array_repeat(t, F.col("__p.passes")), once) if epochs > 1 else F.when(F.col("__p.passes") > 0, F.array(t)).otherwise(once)
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    out = placed.select("row", F.explode(takes).alias("text")).select(*columns)
    if ends.where("__p.equal > 1").isEmpty():
        return out
    twins = placed.where("__at = 0 and __p.equal > 1").dropDuplicates(["__leaf"])
    times = F.concat(F.array_repeat(t, F.col("__p.full").cast("int")), F.when(F.col("__p.cut") < F.col("__p.end.tokens"), F.array(text)).otherwise(F.array().cast("array<string>")))
    return out.union(twins.select("row", F.explode(times).alias("text")).select(*columns))
