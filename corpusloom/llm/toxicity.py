"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicons are mined from a bounded sample of labelled rows, words and word beginnings alike. Each family of mined words, those that begin alike, is
a voter of its own, whose silence says nothing; one voter speaks for the other class where no family is named; pattern voters look at shouting,
punctuation, address and masking. The label model sees votes and the share of labelled rows that are toxic: it
estimates each voter's accuracy by expectation-maximisation, measures which voters agree
beyond what their accuracies explain, and discounts such groups so that they do not count twice. Its
posteriors are the labels of an L1 logistic classifier over words and word beginnings, which scores all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import text_slices, utf8
from .decontaminate import words_of
from .fitting import held_out_flag, labelled_sample, lasso_logistic, sigmoid

SAMPLE = 8_000
#: Voters with a lexicon at most; families beyond that share the last one.
LEXICON_VOTERS = 200
PENALTY = 0.00004
THRESHOLD = 0.7

#: Pattern voters: name and the bytes that make them vote.
PATTERNS = {
    "shouting": re.compile(rb"(?:\b[A-Z]{3,}\b[^A-Za-z]*){4}"),
    "exclaiming": re.compile(rb"!!|\?!"),
    "addressing": re.compile(rb"(?i)\b(?:you|your|du|dein|tu|vous|usted)\b"),
    "masking": re.compile(rb"[A-Za-z][*#@$]{2,}"),
}


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of four to six bytes."""
    return [b"=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def pattern_votes(text: bytes) -> list[bool]:
    return [p.search(text) is not None for p in PATTERNS.values()]


@dataclass
class LabelModel:
    """Accuracies and correlations of voters, from votes alone."""

    prior: float
    on: np.ndarray  # P(vote | toxic)
    off: np.ndarray  # P(vote | not toxic)
    correlation: np.ndarray
    weight: np.ndarray
    silent: np.ndarray  # whether a voter that does not vote says nothing

    @property
    def accuracy(self) -> np.ndarray:
        return self.prior * self.on + (1 - self.prior) * (1 - self.off)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on / self.off), np.where(self.silent, 0.0, np.log((1 - self.on) / (1 - self.off)))
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * yes) + (1 - votes) @ (self.weight * no))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 60, passes: int = 3, silent: np.ndarray | None = None, balance: float | None = None) -> LabelModel:
    """Two-class latent model by expectation-maximisation from the posteriors ``start``; correlated voters share their weight.

    silent: voters whose abstention is no evidence; the others, which speak for either class, keep their whole weight. balance: the share of the
    first class, if it is known.
    """
    n, m = votes.shape
    whole = np.zeros(m, bool) if silent is None else ~silent
    silent = np.zeros(m, bool) if silent is None else silent
    votes, q, model, weight = votes.astype(float), start.astype(float), None, np.ones(votes.shape[1])
    correlation = np.eye(m)
    for _ in range(passes):
        for _ in range(rounds):
            prior = (q.sum() + 1) / (n + 2) if balance is None else balance
            on = (q @ votes + 0.5) / (q.sum() + 1)
            off = ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)
            model = LabelModel(prior, np.clip(on, 1e-4, 1 - 1e-4), np.clip(off, 1e-4, 1 - 1e-4), correlation, weight, silent)
            new = model.posterior(votes)
            moved, q = np.abs(new - q).max(initial=0), new
            if moved < 1e-4:
                break
        rest = votes - (np.outer(q, model.on) + np.outer(1 - q, model.off))
        norm = np.sqrt((rest**2).sum(axis=0)) + 1e-9
        correlation = rest.T @ rest / np.outer(norm, norm)
        strong = correlation**2  # k copies of one voter get 1 / k of a voice each
        np.fill_diagonal(strong, 0)
        weight = np.where(whole, 1.0, 1 / (1 + strong.sum(axis=1)))
        model = LabelModel(model.prior, model.on, model.off, correlation, weight, silent)
        q = model.posterior(votes)
    return model


@dataclass
class ToxicityModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))
    intercept: float = -20.0
    label_model: LabelModel | None = None

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        memo: dict[bytes, tuple[bytes, ...]] = {}
        z = np.full(len(texts), self.intercept)
        use_patterns = any(self.patterns)
        for i, t in enumerate(texts):
            if not t:
                continue
            found: set[bytes] = set()
            for w in set(words_of(t)):
                own = memo.get(w)
                if own is None:
                    own = memo[w] = tuple(f for f in features_of(w) if f in self.weights)
                if own:
                    found.update(own)
            z[i] += sum(self.weights[f] for f in sorted(found))
            if use_patterns:
                z[i] += float(np.dot(self.patterns, pattern_votes(t)))
        return sigmoid(z)


def _without_copies(texts: list[bytes]) -> list[int]:
    """Indexes of texts of which no earlier one has three of the same four least shingle hashes in a row."""
    seen: set[tuple[int, ...]] = set()
    keep = []
    for i, t in enumerate(texts):
        words = words_of(t)
        least = sorted({zlib.crc32(b" ".join(words[j : j + 5])) for j in range(max(1, len(words) - 4))})[:4]
        marks = {tuple(least[:3]), tuple(least[1:])}
        if not marks & seen:
            keep.append(i)
        seen |= marks
    return keep


class FeatureTable:
    """Which features each text of a sample has, as numbers: rows ``row[i]`` have feature ``col[i]``.

    Features are told apart by crc32, so no dictionary of all words is held; those in one text alone are left out.
    """

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        each = [np.unique(np.fromiter((zlib.crc32(f) for w in set(words_of(t)) for f in features_of(w)), np.uint32)) for t in texts]
        every = np.concatenate(each) if each else np.zeros(0, np.uint32)
        every.sort()
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        self.hashes = every[first[np.diff(first, append=len(every)) > 1]]
        del every, first
        rows, cols = [], []
        for i, own in enumerate(each):
            at = np.searchsorted(self.hashes, own).astype(np.int32)
            at = at[self.hashes[np.minimum(at, len(self.hashes) - 1)] == own] if len(self.hashes) else at[:0]
            cols.append(at)
            rows.append(np.full(len(at), i, np.int32))
            each[i] = None
        self.row, self.col = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, cols))

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Of each feature, the weight of the texts that have it."""
        out, step = np.zeros(len(self.hashes)), 1 << 20
        for at in range(0, len(self.row), step):
            out += np.bincount(self.col[at : at + step], weight[self.row[at : at + step]], len(self.hashes))
        return out

    def names(self, texts: list[bytes], wanted: np.ndarray) -> dict[int, bytes]:
        """The features of the wanted numbers; of features with one hash the least."""
        number, found = {int(self.hashes[i]): int(i) for i in wanted}, {}
        for t in texts:
            for w in set(words_of(t)):
                for f in features_of(w):
                    i = number.get(zlib.crc32(f))
                    if i is not None and (i not in found or f < found[i]):
                        found[i] = f
        return found


def mine_lexicon(table: FeatureTable, y: np.ndarray, least: float = 0.005, ratio: float = 4.0) -> np.ndarray:
    """Features of at least two toxic texts and a share ``least`` of them whose smoothed log odds ratio is at least ``ratio``."""
    on, off = table.counts(y), table.counts(1 - y)
    odds = np.log((on + 0.5) / (y.sum() + 1)) - np.log((off + 0.5) / ((1 - y).sum() + 1))
    return np.flatnonzero((on >= max(2, least * y.sum())) & (odds >= ratio))


def lexicon_voters(table: FeatureTable, texts: list[bytes], y: np.ndarray, most: int) -> np.ndarray:
    """For each feature the voter that it belongs to, -1 for none.

    A voter is a family of mined words, those with the same first four bytes, so that forms of one word vote once and families are sources of
    their own. Families are taken by the toxic texts that they name, ``most`` at most; the rest share the last voter.
    """
    lexicon = mine_lexicon(table, y)
    stems = {i: name.removeprefix(b"=")[:4] for i, name in table.names(texts, lexicon).items()}
    toxic, weight = table.counts(y), {}
    for i, stem in stems.items():
        weight[stem] = max(weight.get(stem, 0), toxic[i])
    place = {stem: min(k, most - 1) for k, stem in enumerate(sorted(weight, key=lambda x: (-weight[x], x)))}
    voter_of = np.full(len(table.hashes), -1, np.int16)
    for i, stem in stems.items():
        voter_of[i] = place[stem]
    return voter_of


def fit_toxicity(texts: list[bytes], y: np.ndarray, voters: int = LEXICON_VOTERS, penalty: float = PENALTY) -> ToxicityModel:
    """The classifier; with no toxic row, or with no other, nothing is learned and every score is near the share of label 1."""
    if not len(y) or y.min() == y.max():
        return ToxicityModel(intercept=20.0 if len(y) and y.min() else -20.0)
    keep = _without_copies(texts)
    texts, y = [texts[i] for i in keep], y[keep]
    table = FeatureTable(texts)
    votes = np.zeros((table.n, voters + 1 + len(PATTERNS)), bool)
    votes[:, voters + 1 :] = [pattern_votes(t) for t in texts]
    voter_of = lexicon_voters(table, texts, y, voters)
    voting = voter_of[table.col] >= 0
    votes[table.row[voting], voter_of[table.col[voting]]] = True
    # one voter speaks for the other class: that no family was named
    votes[:, voters] = ~votes[:, :voters].any(axis=1)
    silent = np.arange(votes.shape[1]) < voters
    label_model = fit_label_model(votes, np.clip(votes[:, :voters].sum(axis=1) / 2, 0.02, 0.98), silent=silent, balance=float(np.clip(y.mean(), 0.001, 0.999)))
    posterior = label_model.posterior(votes)
    # features that differ between the posterior classes, none rare
    all_, on = table.counts(np.ones(table.n)), table.counts((posterior >= 0.5).astype(float))
    share = max(1e-6, float((posterior >= 0.5).mean()))
    used = np.flatnonzero((all_ >= max(2, 0.0005 * table.n)) & (np.abs(np.log((on + 0.2) / (all_ * share + 0.2))) >= 1.2))
    place = np.full(len(table.hashes), -1, np.int32)
    place[used] = np.arange(len(used))
    some = place[table.col] >= 0
    row, col, extra, n, d = table.row[some], place[table.col[some]], votes[:, voters + 1 :].astype(float), table.n, len(used)
    times = lambda w: np.bincount(row, w[:d][col], n) + extra @ w[d:]
    back = lambda r: np.concatenate((np.bincount(col, r[row], d), extra.T @ r))
    v = np.ones(d + extra.shape[1])
    for _ in range(15):
        v = back(times(v / np.linalg.norm(v)))
    w, b = lasso_logistic(times, back, posterior, d + extra.shape[1], penalty, 0.25 * (np.linalg.norm(v) / n + 1), 1500)
    names = table.names(texts, used[np.flatnonzero(w[:d])])
    return ToxicityModel({names[i]: float(x) for i, x in zip(used, w) if x}, [float(x) for x in w[d:]], b, label_model)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, fold: int = 1, sample: int = SAMPLE) -> ToxicityModel:
    """The model from at most ``sample`` labelled rows outside the held-out fold; these texts alone reach the driver."""
    chosen = labelled_sample(labels, label_col, id_col, folds, fold, sample)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("id"))
    rows = rows.where("t is not null").select("id", "t", "y").orderBy(F.xxhash64("id"), "t").limit(sample).toArrow()
    texts, y = (rows.column("t").to_pylist(), rows.column("y").to_numpy().astype(float)) if rows.num_rows else ([], np.zeros(0))
    del rows
    model = fit_toxicity(texts, y)
    model.label_model = None  # not needed for scores
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 3, fold: int = 1, sample: int = SAMPLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``; whole texts, no shuffle of them.

    Labels are learned from at most ``sample`` rows outside the held-out fold. Defined cases: null and empty
    texts get the score of a text without words; rows that share an id are scored each; a null id is held out; labels that
    are null, not 0 or 1, or of unknown ids are ignored; without labels of both classes every score is near 0 (near 1 if
    all are toxic); an empty table gives an empty result; other columns are ignored.
    """
    model = learn_toxicity(docs, labels, id_col, text_col, label_col, folds, fold, sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(model.scores(utf8(part.column("t")).to_pylist()))], [id_col, "score"])

    scored = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(kernel, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, held_out_flag(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold. Rows are not shuffled.

    Defined cases: rows are judged by their text alone, so rows of equal texts stay or go together, whatever their ids, null ones too; null and
    empty texts are judged as texts without words; without labels of both classes nothing is learned, and all rows stay (or go, if all labels are 1);
    an empty table gives an empty result; all columns stay as they are, whatever their names.
    """
    model = learn_toxicity(docs, labels, id_col, text_col, **options)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = text_slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")
        return pa.array(np.concatenate([model.scores(utf8(p.column("t")).to_pylist()) for p in parts] or [np.zeros(0)]))

    return docs.where(score(F.col(text_col)) < threshold)
