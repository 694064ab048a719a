"""Line dedup by winnowing over line hashes.

A repeated run is a run of consecutive lines that occurred before, in an earlier document or
earlier in the same one, and that has at least ``min_lines`` lines or ``min_words`` words. Later runs
are deleted, the first stays. Blank lines are kept and do not part a run.

Windows are the shortest runs that qualify, from each line onwards and from each line backwards; a line lies in
some repeated run exactly if it lies in a window that occurred before, so extending a match both ways is the
union of such windows, and no pair of occurrences is ever listed. The least line hash of a window is its
fingerprint: equal windows select equal fingerprints, so windows whose fingerprint is selected at one
place only are dropped after one narrow count. What is left is compared by 128 bits of the whole window with
the first occurrence. Work grows with the number of lines; a passage that a third of all documents share
is one row on the unique side of a join. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

MIN_LINES = 3
MIN_WORDS = 50

_BLANK = r"[\x20\x09-\x0D]+"
_OUTER = " \t\n\x0b\x0c\r"


def _line_table(text: Column) -> Column:
    """For each line that is not blank: its position, two hashes of it without outer white space, its words."""
    bare = F.transform(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(_OUTER)))  # once for each line, as lambdas share nothing

    def row(line: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), F.when(line == "", 0).otherwise(F.size(F.split(line, _BLANK))).alias("w"))

    return F.filter(F.transform(bare, row), lambda x: x["w"] > 0)


def _windows(lines: Column, min_lines: int, min_words: int) -> Column:
    """Shortest qualifying windows as ``(start, f, h, g, pos)``; starts count lines that are not blank, ``pos`` all lines."""
    at = lambda i, k: F.get(lines, i + F.lit(k))

    def words(i: Column, a: int, b: int) -> Column:
        return reduce(lambda x, y: x + y, (at(i, k)["w"] for k in range(a, b)), F.lit(0))

    found = []
    for n in range(1, min_lines + 1):

        def fits(i: Column) -> Column:
            full = F.lit(True) if n == min_lines else words(i, 0, n) >= min_words
            return full & ((words(i, 0, n - 1) < min_words) | (words(i, 1, n) < min_words)) if n > 1 else full

        def window(i: Column) -> Column:
            own = [at(i, k) for k in range(n)]
            least = F.least(*(x["h"] for x in own)) if n > 1 else own[0]["h"]
            h, g = (F.xxhash64(F.lit(n), *(x[c] for x in own)).alias(c) for c in "hg")
            return F.struct(i.alias("start"), least.alias("f"), h, g, F.array(*(x["pos"] for x in own)).alias("pos"))

        starts = F.when(F.size(lines) >= n, F.sequence(F.lit(0), F.size(lines) - n)).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(F.filter(starts, fits), window))
    return F.concat(*found)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, th, del)``: for each distinct (id, text) with later repeated runs, the positions of the lines to delete.

    ``th`` is a hash of the text; documents are ordered by id, nulls first, then by th.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _line_table(F.col(text_col)).alias("ls"))
    windows = materialize(rows.select("id", "th", F.inline(_windows(F.col("ls"), min_lines, min_words))))
    where = F.struct("id", "th", "start")
    # equal rows of a table stand at one place
    prints = windows.groupBy("f").agg(F.min(where).alias("a"), F.max(where).alias("z")).where("a < z").select("f")
    kept = windows.join(prints, "f", "left_semi")
    first = kept.groupBy("h", "g").agg(F.min(where).alias("a"), F.max(where).alias("z")).where("a < z").select("h", "g", "a")
    later = kept.join(first, ["h", "g"]).where(where > F.col("a"))
    # a later window may overlap the first one in its own document; only what comes after it goes
    same = F.col("a.id").eqNullSafe(F.col("id")) & (F.col("a.th") == F.col("th"))
    skip = F.when(same, F.greatest(F.lit(0), F.col("a.start") + F.size("pos") - F.col("start"))).otherwise(F.lit(0))
    gone = later.select("id", "th", F.explode(F.slice("pos", skip + 1, F.greatest(F.size("pos") - skip, F.lit(0)))).alias("p"))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("p")).alias("del"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id_col, n_lines, n_removed, text_col)``: every row of ``docs`` with later repeated runs cut out of its text.

    Defined cases: null texts stay null with no lines, empty ones stay empty; rows equal in id and text are one
    document and cut alike; rows that share an id are ordered by a hash of their text; null ids come first; a text
    that is all repeats becomes empty; other columns are ignored.
    """
    gone = repeated_lines(docs, id_col, text_col, min_lines, min_words)
    gone = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("del").alias("__del"))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    joined = base.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    joined = joined.withColumn("lines", F.split("t", "\n", -1))  # once a row: what a lambda calls is called for each element
    lines = F.col("lines")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__del"))
    cut = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        F.col("id").alias(id_col), F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("__del"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("__del").isNull(), F.col("t")).otherwise(cut).alias(text_col),
    )
