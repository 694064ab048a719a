"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts become word sequences (A-Z lower-cased, ASCII punctuation and white space between words). An
item of n words is found in a document where some run of its words is within
floor(n * (1 - similarity)) word edits of the item.

Every word of a document starts a window of each item's size. A window with more words outside the
items' vocabulary than edits are allowed cannot match and is left out; that test is exact. The others
take a CGK random walk (Chakraborty, Goldenberg, Koucky 2016): step j emits the word under the
pointer and moves on if a random bit of (j, word) says so, which maps small edit distance to small
Hamming distance. Each repetition has its own walk and samples a few steps of it; window and item whose
samples agree are candidates. A candidate is decided by Myers' bit-vector search of the item in the
window's surroundings, so results hold no false hits, and an unedited copy is never missed. The number of repetitions follows from a target recall.

Documents are read once per block of items and never shuffled; a block of items is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_slices, utf8

SIMILARITY = 0.8
MIN_WORDS = 5
SAMPLED = 2
#: Wanted share of found items with as many edits as are allowed, and the share of them that one repetition of ``SAMPLED`` steps finds at ``SIMILARITY``, as measured on
#: made-up documents with a fifth of the words edited (0.998 by 16 repetitions).
RECALL = 0.999995
FOUND_BY_ONE = 0.32
SEED = 29
BLOCK_ITEMS = 20_000
#: Bytes of text searched at a time: arrays of some ten bytes for each of its words.
SCAN_BYTES = 12 << 20
#: Steps are sampled below this multiple of the item's words, where the walk is still inside the item.
REACH = 1.5


def found_share(similarity: float, sampled: int) -> float:
    """The share of items with as many edits as the similarity allows that one repetition finds.

    All sampled steps must agree, and the agreement of one falls exponentially with the share of edited words: the measured share, to the power of edits and steps.
    """
    return FOUND_BY_ONE ** ((1 - similarity) * sampled / ((1 - SIMILARITY) * SAMPLED))


def repetitions_for(recall: float, found_by_one: float = FOUND_BY_ONE) -> int:
    """How many repetitions reach the recall, each with a walk of its own."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found_by_one))) if found_by_one < 1 else 1


REPETITIONS = repetitions_for(RECALL)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def best_match(masks: dict[int, int], n: int, window: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of ``window``, and the end of the first such run."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for i, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, i
    return best, end


class ItemIndex:
    """Walks and samples of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, min_words: int, repetitions: int, sampled: int, seed: int):
        rows = [(k, w) for k, t in items if len(w := words_of(t)) >= min_words]
        self.vocabulary = {w: i for i, w in enumerate(sorted({x for _, ws in rows for x in ws}), 1)}
        self.item_ids = [k for k, _ in rows]
        self.words = [[self.vocabulary[x] for x in ws] for _, ws in rows]
        self.masks: list[dict[int, int]] = []
        for ws in self.words:
            masks: dict[int, int] = {}
            for i, w in enumerate(ws):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
        self.sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.lengths = sorted({len(ws) for ws in self.words})
        self.edits = {n: int(n * (1 - similarity) + 1e-9) for n in self.lengths}
        self.base = len(self.vocabulary) + 2
        if self.base**sampled >= 1 << 62:
            raise ValueError("too many sampled steps for the vocabulary")
        rng, top = np.random.default_rng(seed), max(self.lengths, default=1)
        self.factors = rng.integers(1, 1 << 62, (repetitions, int(REACH * top) + 1), dtype=np.uint64) * 2 + 1
        spots = np.sort(rng.random((repetitions, sampled)), axis=1)
        self.steps = [{n: [int(u * REACH * n) for u in row] for n in self.lengths} for row in spots]
        self.members = {n: [i for i, ws in enumerate(self.words) if len(ws) == n] for n in self.lengths}
        self.every = np.arange(self.base)
        self.distinct = [np.unique(ws)[:64] for ws in self.words]
        # adjacent equal words that a match's window can hold: an edit makes two at most, the end of the window as many as edits
        pairs = [sum(a == b for a, b in zip(ws, ws[1:])) for ws in self.words]
        self.repeats = {n: max(p for p, ws in zip(pairs, self.words) if len(ws) == n) + 3 * self.edits[n] for n in self.lengths}
        self.keys: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for r in range(repetitions):
            by_length = {}
            for n, own in self.members.items():
                # beyond its end an item emits a mark that no document has
                flat = np.array([self.words[i] + [self.base - 1] * (int(REACH * n) + 1) for i in own], np.int64)
                starts = np.arange(len(own)) * flat.shape[1]
                (key,) = self.walk(flat.ravel(), starts, np.full(len(own), n), r, {n: np.arange(len(own))}).values()
                order = np.argsort(key, kind="stable")
                by_length[n] = key[order], np.array(own)[order]
            self.keys.append(by_length)

    def bits(self, r: int, j: int, word: np.ndarray) -> np.ndarray:
        return (((word.astype(np.uint64) + np.uint64(1)) * self.factors[r, j]) >> np.uint64(41) & np.uint64(1)).astype(np.int32)

    def walk(self, ids: np.ndarray, starts: np.ndarray, longest: np.ndarray, r: int, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Sampled keys by item length. starts: in falling order of ``longest``, the longest item length tried there."""
        records: dict[int, list[int]] = {}
        for n in wanted:
            for j in self.steps[r][n]:
                records.setdefault(j, []).append(n)
        keys = {n: np.zeros(len(own), np.int64) for n, own in wanted.items()}
        last, most = np.zeros(max(wanted) + 1, np.int64), 0
        for n in sorted(wanted):
            most = max(most, *self.steps[r][n])
            last[n] = most
        ends = last[longest]  # falls as longest does
        pos = starts.astype(np.int32)
        for j in range(most + 1):
            active = int(np.searchsorted(-ends, -j, side="right"))
            word = ids[pos[:active]]
            for n in records.get(j, ()):
                keys[n] = keys[n] * self.base + word[wanted[n]]
            # the bit of every word at this step is cheaper to make once than for each pointer
            pos[:active] += self.bits(r, j, self.every)[word] if self.base < active else self.bits(r, j, word)
        return keys

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Pairs (start, item) to verify. ids: word ids, 0 outside the vocabulary, with padding at the end."""
        total = len(ids) - self.padding
        known = np.concatenate(([0], np.cumsum(ids > 0, dtype=np.int32)))
        again = np.zeros(len(ids) + 1, np.int32)
        np.cumsum((ids[1:] == ids[:-1]) & (ids[1:] > 0), out=again[2:])
        longest, passing = np.zeros(total, np.int32), {}
        for n in self.lengths:
            fits = known[n : n + total] - known[:total] >= n - self.edits[n]
            passing[n] = np.flatnonzero(fits & (again[n : n + total] - again[1 : 1 + total] <= self.repeats[n]))
            longest[passing[n]] = n
        starts = np.flatnonzero(longest)
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        order = np.argsort(-longest[starts], kind="stable")
        starts = starts[order]
        place = np.zeros(total, np.int32)
        place[starts] = np.arange(len(starts))
        wanted = {n: place[p] for n, p in passing.items() if len(p)}
        found = []
        for r in range(len(self.keys)):
            for n, key in self.walk(ids, starts, longest[starts], r, wanted).items():
                known_keys, items = self.keys[r][n]
                a = np.searchsorted(known_keys, key, "left")
                hit = np.flatnonzero(known_keys[np.minimum(a, len(known_keys) - 1)] == key)
                if len(hit):
                    times = np.searchsorted(known_keys, key[hit], "right") - a[hit]
                    at = np.repeat(a[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    found.append(np.repeat(starts[wanted[n][hit]], times).astype(np.int64) * len(self.words) + items[at])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        pairs = np.stack((both // len(self.words), both % len(self.words)), axis=1)
        return pairs[self.enough_words(ids, pairs)]

    def enough_words(self, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Whether the surroundings of each candidate hold enough different words of its item, as an edit takes one away at most."""
        ok = np.zeros(len(pairs), bool)
        order = np.argsort(pairs[:, 1], kind="stable")
        items, starts = np.unique(pairs[order, 1], return_index=True)
        for item, own in zip(items.tolist(), np.split(order, starts[1:])):
            words, n = self.distinct[item], self.sizes[item]
            edits = self.edits[n]
            for at in range(0, len(own), 1 << 14):
                some = own[at : at + (1 << 14)]
                near = ids[np.maximum(pairs[some, :1] + np.arange(-edits, n + edits), 0)]
                place = np.minimum(np.searchsorted(words, near), len(words) - 1)
                bits = np.where(words[place] == near, np.uint64(1) << place.astype(np.uint64), np.uint64(0))
                ok[some] = np.bitwise_count(np.bitwise_or.reduce(bits, axis=1)) >= len(words) - edits
        return ok

    @property
    def padding(self) -> int:
        return int((REACH + 1) * max(self.lengths, default=0)) + 2

    def matches(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int]]:
        """``(row, item, distance, word_end)``: the best occurrence of each item in each text."""
        get, parts, ends = self.vocabulary.get, [], []
        at = 0
        for t in texts:
            ws = words_of(t) if t else []
            own = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
            at += len(own) + 1
            parts += [own, np.zeros(1, np.int32)]
            ends.append(at - 1)
        if not parts:
            return []
        ids = np.concatenate([*parts, np.zeros(self.padding, np.int32)])
        ends_at = np.array(ends)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = self.candidates(ids)
        for (start, item), row in zip(pairs.tolist(), np.searchsorted(ends_at, pairs[:, 0], "left").tolist()):
            had = best.get((row, item))
            if had and not had[0]:
                continue
            n = len(self.words[item])
            begin = ends[row - 1] + 1 if row else 0
            low, high = max(begin, start - self.edits[n]), min(ends[row], start + n + self.edits[n])
            distance, end = best_match(self.masks[item], n, ids[low:high].tolist())
            if distance <= self.edits[n] and (not had or distance < had[0]):
                best[row, item] = distance, low + end - begin
        return [(row, item, d, e) for (row, item), (d, e) in best.items()]


def item_blocks(benchmark: DataFrame, item_id_col: str, item_text_col: str, block_items: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's rows in blocks of about ``block_items``, one at a time on the driver; one empty block if there are none."""
    items = benchmark.select(F.col(item_id_col).alias("k"), F.col(item_text_col).cast("binary").alias("t")).where("t is not null")
    blocks = max(1, -(-items.count() // block_items))
    for i in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == i)
        yield [(r["k"], bytes(r["t"])) for r in some.collect()]


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, min_words: int = MIN_WORDS, repetitions: int | None = None, sampled: int = SAMPLED, seed: int = SEED, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``(id_col, item_id, n_words, distance, similarity, word_end)``: each item that each row of ``docs`` holds, at its best place.

    Defined cases: null and empty texts hold nothing; items that are null or shorter than ``min_words`` match
    nothing, as chance would match them everywhere; items of equal words are all reported; repeated rows are
    reported each; null ids are carried; an empty benchmark or table gives an empty result; other columns are
    ignored; the result's columns after the id are named as above, whatever the id is called, unless it has one of these names: then it must be renamed first (ValueError).
    A block holds ``block_items`` items at most; for each block the documents are read once more. Without ``repetitions`` there are as many as ``RECALL`` needs.
    """
    if id_col in ("item_id", "n_words", "distance", "similarity", "word_end"):
        raise ValueError(f"the id column {id_col!r} has the name of a result")
    repetitions = repetitions or repetitions_for(RECALL, found_share(similarity, sampled))
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id {item_kind}, n_words int, distance int, similarity double, word_end int"
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def scan(block: list[tuple[int, bytes]]) -> DataFrame:
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block, similarity, min_words, repetitions, sampled, seed)
            for batch in batches:
                for part in text_slices(batch, "t", SCAN_BYTES):
                    rows = index.matches(utf8(part.column("t")).to_pylist()) if index.words else []
                    if rows:
                        row, item, distance, end = (np.array(x) for x in zip(*rows))
                        n = np.array([len(index.words[i]) for i in item])
                        columns = [part.column("k").take(pa.array(row)), pa.array([index.item_ids[i] for i in item], {"int": pa.int32(), "bigint": pa.int64()}.get(item_kind))]
                        columns += [pa.array(x.astype(np.int32)) for x in (n, distance)] + [pa.array(1 - distance / n), pa.array(end.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, [id_col, "item_id", "n_words", "distance", "similarity", "word_end"])

        return source.mapInArrow(kernel, schema)

    out = None
    for block in item_blocks(benchmark, item_id_col, item_text_col, block_items):
        out = scan(block) if out is None else out.union(scan(block))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item. Rows are not shuffled; all their columns stay.

    Defined cases: null and empty texts hold nothing and stay; items that are null or shorter than ``min_words`` match nothing; rows are judged by
    their text alone, so repeated rows and null ids share its fate; an empty benchmark drops nothing, an empty table gives an empty result.
    """
    for block in item_blocks(benchmark, item_id_col, item_text_col, block_items):
        docs = docs.where(~_holds_item(block, similarity, min_words)(F.col(text_col)))
    return docs


def _holds_item(block: list[tuple[int, bytes]], similarity: float, min_words: int):
    @F.arrow_udf("boolean")
    def holds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = ItemIndex(block, similarity, min_words, repetitions_for(RECALL, found_share(similarity, SAMPLED)), SAMPLED, SEED)
        for column in texts:
            found = np.zeros(len(column), bool)
            if index.words:
                at = 0
                for part in text_slices(pa.RecordBatch.from_arrays([column], ["t"]), "t", SCAN_BYTES):
                    found[[at + m[0] for m in index.matches(utf8(part.column("t")).to_pylist())]] = True
                    at += part.num_rows
            yield pa.array(found)

    return holds
