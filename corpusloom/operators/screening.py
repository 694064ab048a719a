"""Screening logs: stopping rules, exports, leftover ranks, recall curves, re-ranked orders, simulated review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_openalex
from ..plans.materialize import materialize, scratch_path
from ..plans.order import running_sum, with_position


def stopping_point(log: DataFrame, patience: int = 100) -> DataFrame:
    """One row ``reviewed``: records read until ``patience`` irrelevant ones follow each other after a relevant one; all if never.

    The island of a record is the number of relevant ones before it, a prefix sum over ranges; an island's length needs one row each.
    """
    rows = materialize(running_sum(log.select("record_id", "label", "time"), "label", F.col("time"), F.col("record_id"), name="found"))
    islands = rows.where("found > 0").groupBy("found").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.min("label").alias("m"))
    # an island begins with its relevant record
    stops = islands.where(F.col("last") - F.col("first") >= patience).agg(F.min(F.col("first") + patience + 1).alias("stop"))
    total = rows.agg(F.count("*").alias("n"))
    return stops.crossJoin(total).select(F.coalesce("stop", "n").alias("reviewed"))


def reviewed_prefix(log: DataFrame, patience: int = 100) -> DataFrame:
    """The log with ``review_order`` from 0 and whether each record was read before the stop."""
    stop = stopping_point(log, patience).first()["reviewed"]
    return with_position(log, F.col("time"), F.col("record_id"), name="review_order").withColumn("reviewed", F.col("review_order") < stop)


def enrich(papers: DataFrame, log: DataFrame) -> DataFrame:
    """Papers with ``reviewed, review_order, found_before_stopping``; -1 and false where the log has no row."""
    seen = log.select("record_id", F.col("review_order").alias("o"), F.col("reviewed").alias("r"))
    wide = papers.join(seen, "record_id", "left").withColumn("reviewed", F.coalesce("r", F.lit(False)))
    return wide.withColumn("review_order", F.when(F.col("reviewed"), F.col("o")).otherwise(F.lit(-1)).cast("long")).withColumn("found_before_stopping", F.col("reviewed") & (F.col("label_included") == 1)).drop("o", "r")


def _export(rows: DataFrame, label) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select("record_id", canonical_openalex(text("openalex_id")).alias("openalex_id"), text("doi").alias("doi"), text("title").alias("title"), text("abstract").alias("abstract"), label.cast("int").alias("label_included"))


def leftover_documents(enriched: DataFrame) -> DataFrame:
    """Found ones and all unread ones; the label is 1 only for those found."""
    found = F.col("reviewed") & (F.col("label_included") == 1)
    return _export(enriched.where(found | ~F.col("reviewed")), F.when(found, 1).otherwise(0))


def found_documents(enriched: DataFrame) -> DataFrame:
    return _export(enriched.where(F.col("reviewed") & (F.col("label_included") == 1)), F.lit(1))


def leftover_with_truth(enriched: DataFrame) -> DataFrame:
    """Found ones, then unread ones, with true labels and what the review saw; ``position`` is their order, each part by record."""
    rows = enriched.where((F.col("reviewed") & (F.col("label_included") == 1)) | ~F.col("reviewed"))
    rows = rows.withColumn("asreview_label", F.when(F.col("reviewed"), F.col("label_included"))).withColumn("asreview_time", F.when(F.col("reviewed"), F.col("review_order")))
    placed = with_position(rows, F.when(F.col("reviewed"), 0).otherwise(1), F.col("record_id"))
    return placed.select("position", F.coalesce("record_id", F.lit(-1)).alias("record_id"), F.coalesce("label_included", F.lit(0)).alias("label_included"), "asreview_label", "asreview_time")


def leftover_ranks(log: DataFrame, target: DataFrame, patience: int = 100) -> DataFrame:
    """Of each ``target(record_id)``: place in the full log, in what is left after found ones, among unread ones, and in the export; from 1.

    -1 in the leftover orders if the record was found before the stop.
    """
    rows = materialize(reviewed_prefix(log, patience))
    wanted = F.broadcast(target.select("record_id").distinct())
    own = rows.join(wanted, "record_id").select(F.col("record_id").alias("target"), F.col("review_order").alias("mine"), F.col("reviewed").alias("read"))
    found, unread = F.col("reviewed") & (F.col("label") == 1), ~F.col("reviewed")
    pairs = rows.crossJoin(F.broadcast(own))  # a few known records
    sums = pairs.groupBy("target", "mine", "read").agg(
        F.count_if(found).alias("found"), F.count_if(unread & (F.col("review_order") < F.col("mine"))).alias("ahead"), F.count_if(unread & (F.col("record_id") < F.col("target"))).alias("smaller"),
    )
    left = lambda c: F.when(F.col("read"), F.lit(-1)).otherwise(c).cast("long")
    return sums.select(
        F.col("target").alias("record_id"), (F.col("mine") + 1).alias("full_rank"), left(F.col("found") + F.col("ahead") + 1).alias("leftover_rank"), left(F.col("ahead") + 1).alias("unread_rank"), left(F.col("found") + F.col("smaller") + 1).alias("export_rank"),
    )


def simulation_statistics(enriched: DataFrame) -> DataFrame:
    read, relevant = F.col("reviewed"), F.col("label_included") == 1
    sums = enriched.agg(F.count("*").alias("total"), F.count_if(relevant).alias("relevant"), F.count_if(read).alias("read_records"), F.count_if(read & relevant).alias("found"))
    return sums.select("total", "relevant", "read_records", "found", (F.col("relevant") - F.col("found")).alias("missed"), (F.col("found") / F.col("relevant") * 100).alias("recall_percent"), (F.col("read_records") / F.col("total")).alias("efficiency"))


def recall_curve(log: DataFrame) -> DataFrame:
    """``position, recall``: the share of relevant records among those read so far."""
    total = log.agg(F.sum("label")).first()[0] or 0
    rows = running_sum(log, "label", F.col("time"), F.col("record_id"), name="found")
    return rows.select((F.col("position") + 1).alias("position"), (F.col("found") / F.lit(float(total)) if total else F.lit(0.0)).alias("recall"))


def extend_curve(curve: DataFrame, length: int) -> DataFrame:
    """The curve held flat up to ``length`` positions."""
    last = curve.agg(F.max("position").alias("p"), F.max_by("recall", "position").alias("recall"))
    rest = last.where(F.col("p") < length).select(F.explode(F.sequence(F.col("p") + 1, F.lit(length).cast("long"))).alias("position"), "recall")
    return curve.union(rest)


def reranked_order(log: DataFrame, target: DataFrame, new_rank: int, patience: int = 100) -> DataFrame:
    """The order of reading if the target is met at ``new_rank`` after the stop: read records, others, the target in its new place."""
    rows = reviewed_prefix(log, patience).join(F.broadcast(target.select("record_id", F.lit(True).alias("t"))), "record_id", "left")
    rows = materialize(rows.withColumn("t", F.coalesce("t", F.lit(False)) & ~F.col("reviewed")))
    size = rows.agg(F.count_if("reviewed").alias("stop"), F.count("*").alias("n")).first()
    place = min(size["stop"] + new_rank, size["n"])
    others = with_position(rows.where(~F.col("t")), F.col("review_order"), name="p").select("record_id", "label", (F.col("p") + 1 + F.when(F.col("p") + 1 >= place, 1).otherwise(0)).alias("position"))
    return others.union(rows.where("t").select("record_id", "label", F.lit(place).cast("long").alias("position")))


def documents_saved(log: DataFrame, target: DataFrame, new_rank: int, patience: int = 100) -> DataFrame:
    """Where the target was and is met, and what that saves."""
    rows = materialize(reviewed_prefix(log, patience))
    size = rows.agg(F.count_if("reviewed").alias("stop"), F.count("*").alias("n"))
    own = rows.join(F.broadcast(target.select("record_id")), "record_id").select("record_id", (F.col("review_order") + 1).alias("original"))
    new = F.least(F.col("stop") + new_rank, F.col("n"))
    return own.crossJoin(F.broadcast(size)).select("record_id", "original", new.alias("reranked"), (F.col("original") - new).alias("documents_saved"), ((F.col("original") - new) / F.col("original") * 100).alias("improvement_percent"))


def sample_documents(papers: DataFrame, n_relevant: int = 5, n_irrelevant: int = 15, label: str = "label_included") -> DataFrame:
    """The first of each class by id: two bounded top-k, no sort of all."""
    take = lambda y, n: papers.where(F.col(label) == y).orderBy("id").limit(n).select("id", label)
    return take(1, n_relevant).union(take(0, n_irrelevant))


def stratified_split(papers: DataFrame, test_share: float = 0.2, seed: int = 42, label: str = "label_included") -> DataFrame:
    """Papers with ``is_test``: of each class a share, rounded down, of relevant ones at least one, in the order of a seeded hash."""
    from ..plans.order import with_group_position

    rows = with_group_position(papers.select("id", F.col(label).cast("int").alias(label)), label, F.xxhash64(F.lit(seed), "id"), F.col("id"), name="p")
    sizes = papers.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    quota = F.floor(F.col("n") * test_share)
    sizes = sizes.withColumn("quota", F.when(F.col(label) == 1, F.greatest(F.lit(1), quota)).otherwise(quota))
    return rows.join(F.broadcast(sizes), label).select("id", label, (F.col("p") < F.col("quota")).alias("is_test"))


def check_labels(papers: DataFrame, label: str) -> None:
    """Labels are exactly 0 and 1."""
    found = {r[0] for r in papers.select(label).distinct().limit(3).collect()}
    if found != {0, 1}:
        raise ValueError(f"labels must be 0 and 1, found {sorted(map(str, found))}")


#: Learners of the simulated review; unknown names mean naive Bayes.
LEARNERS = ("nb", "svm", "lr", "rf")


def _learner(name: str):
    from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier

    common = {"featuresCol": "x", "labelCol": "y", "weightCol": "w"}
    made = {"svm": lambda: LinearSVC(maxIter=20, regParam=0.01, **common), "lr": lambda: LogisticRegression(maxIter=20, regParam=0.01, **common), "rf": lambda: RandomForestClassifier(seed=42, numTrees=20, **common)}
    return made.get(name, lambda: NaiveBayes(**common))()


def _bare(model, spark):
    """The model without its training summary: that holds the session, which cannot be sent to tasks once anything has been observed in it."""
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(spark)
    model.save(path)
    return type(model).load(path)


#: Records in one batch of the simulated review at most, unless more are asked for; they pass through one task.
LARGEST_BATCH = 10_000


def _read_until_stop(best: DataFrame, run: int, patience: int) -> tuple[DataFrame, int, int]:
    """``best(id, key, y)`` up to the record at which the stopping rule fires, its size, and the irrelevant ones in a row at its end.

    run: irrelevant ones in a row before it.
    """
    rows = materialize(running_sum(best, "y", F.col("key"), F.col("id"), name="found"))
    islands = rows.groupBy("found").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    # the first island goes on where the batches before ended, the others begin with their relevant record
    islands = islands.withColumn("before", F.when(F.col("found") == 0, F.lit(run)).otherwise(-1))
    islands = islands.withColumn("length", F.col("before") + F.col("last") - F.col("first") + 1)
    end = islands.agg(F.min(F.when(F.col("length") >= patience, F.col("first") + patience - F.col("before"))), F.max("last") + 1, F.max_by("length", "found")).first()
    if end[0] is None:
        return rows.select("id", "key", "y"), end[1], end[2]
    return rows.where(F.col("position") < end[0]).select("id", "key", "y"), end[0], patience


def _read_until_last(best: DataFrame, missing: int) -> tuple[DataFrame, int, int]:
    """``best(id, key, y)`` up to the record that is the last of ``missing`` relevant ones, its size, and how many are missing then."""
    rows = materialize(running_sum(best, "y", F.col("key"), F.col("id"), name="found"))
    end = rows.agg(F.min(F.when((F.col("found") >= missing) & (F.col("y") == 1), F.col("position") + 1)), F.count("*"), F.sum("y")).first()
    if end[0] is None:
        return rows.select("id", "key", "y"), end[1], missing - int(end[2] or 0)
    return rows.where(F.col("position") < end[0]).select("id", "key", "y"), end[0], 0


#: Settings of the review's features and balance, as they are by default and as they were tuned for the support vector machine.
SETTINGS = {"plain": {"ngrams": 1, "max_df": 1.0, "ratio": 1.0}, "tuned": {"ngrams": 2, "max_df": 0.95, "ratio": 9.8}}


def review_vectors(texts: DataFrame, features: int, ngrams: int = 1, max_df: float = 1.0) -> DataFrame:
    """``id, y, x`` of ``texts(id, y, text)``: hashed TF-IDF of words and runs of up to ``ngrams`` words; places in more than ``max_df`` of all texts are 0."""
    from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, NGram, Tokenizer
    from pyspark.ml.linalg import Vectors

    words = Tokenizer(inputCol="text", outputCol="words").transform(texts)
    for n in range(2, ngrams + 1):
        words = NGram(n=n, inputCol="words", outputCol=f"runs{n}").transform(words)
    terms = words.withColumn("terms", F.concat("words", *(f"runs{n}" for n in range(2, ngrams + 1))))
    counted = HashingTF(inputCol="terms", outputCol="tf", numFeatures=features).transform(terms).select("id", "y", "tf")
    model = IDF(inputCol="tf", outputCol="x" if max_df >= 1 else "weighted").fit(counted)
    vectors = model.transform(counted)
    if max_df < 1:
        kept = Vectors.dense([float(f <= max_df * model.numDocs) for f in model.docFreq])
        vectors = ElementwiseProduct(scalingVec=kept, inputCol="weighted", outputCol="x").transform(vectors)
    return vectors.select("id", "y", "x")


def simulate_review(papers: DataFrame, learner: str = "nb", batch: int = 50, rounds: int | None = None, label: str = "label_included", features: int = 1 << 14, patience: int = 100, stopper: str = "consecutive", settings: str = "plain") -> DataFrame:
    """``id, review_order, label``: top-down reading until both classes are seen, then the most likely relevant ones, batch by batch.

    The stopper ``consecutive`` ends the review with the record at which ``patience`` irrelevant ones have followed each other after a relevant one
    (a patience of -1 is none), ``last_relevant`` with the last relevant record; else it ends with the last record,
    or after ``rounds`` batches if these are given; records of one class alone are all read top-down. Each round fits TF-IDF features of title and abstract, with
    relevant records weighing ``ratio`` times as much as all others together (``SETTINGS``). A batch is a quarter of what was read, ``batch`` records at least. What was read is a table; only counts
    come to the driver.
    """
    from pyspark.ml.functions import vector_to_array

    from ..functions.columns import title_abstract

    if stopper not in ("consecutive", "last_relevant"):
        raise ValueError(f"unknown stopper {stopper!r}")
    chosen = SETTINGS[settings]

    text = papers.select("id", F.col(label).cast("double").alias("y"), title_abstract(F.col("title"), F.col("abstract")).alias("text"))
    vectors = review_vectors(text, features, chosen["ngrams"], chosen["max_df"])
    vectors = materialize(vectors)  # every round reads them; cached blocks would go with their executors
    first = vectors.groupBy("y").agg(F.min("id").alias("i"), F.count("*").alias("n")).agg(F.max("i"), F.count("*"), F.sum("n"), F.sum(F.when(F.col("y") == 1, F.col("n")))).first()
    both, total, relevant = first[1] == 2, first[2] or 0, first[3] or 0
    seeds = vectors.where(F.col("id") <= first[0]) if both else vectors
    read = materialize(seeds.select("id", F.col("id").cast("double").alias("key"), F.lit(0).alias("round"), "y"))
    last = read.agg(F.max(F.when(F.col("y") == 1, F.col("id")))).first()[0]
    done, run, k = read.count(), read.where(F.col("id") > last).count() if both else 0, 0
    missing = relevant - read.where("y = 1").count()
    until_last, patience = stopper == "last_relevant", total + 1 if patience < 0 else patience
    while both and done < total and (missing if until_last else run < patience) and (rounds is None or k < rounds):
        k += 1
        train = vectors.join(read.select("id"), "id", "left_semi")
        share = train.agg(F.avg("y")).first()[0]
        weighted = train.withColumn("w", F.when(F.col("y") == 1, F.lit(0.5 * chosen["ratio"] / share)).otherwise(F.lit(0.5 / (1 - share))))
        model = _bare(_learner(learner).fit(weighted), papers.sparkSession)
        scored = model.transform(vectors.join(read.select("id"), "id", "left_anti"))
        raw = vector_to_array("rawPrediction")
        score = raw[1] - raw[0]
        best = scored.select("id", (-score).alias("key"), "y").orderBy("key", "id").limit(max(batch, min(done // 4, LARGEST_BATCH)))
        if until_last:
            taken, n, missing = _read_until_last(best, missing)
        else:
            taken, n, run = _read_until_stop(best, run, patience)
        done += n
        read = materialize(read.union(taken.select("id", "key", F.lit(k).alias("round"), "y")))
    placed = with_position(read, F.col("round"), F.col("key"), F.col("id"), name="review_order")
    return placed.select("id", "review_order", F.col("y").cast("int").alias("label"))
