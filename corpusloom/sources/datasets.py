"""Reading and writing datasets: configuration, papers, corpora, embeddings, results."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import resolve_like
from ..functions.vectors import norm
from . import npy

PAPERS = T.StructType([T.StructField(n, t) for n, t in (("record_id", T.LongType()), ("openalex_id", T.StringType()), ("doi", T.StringType()), ("title", T.StringType()), ("abstract", T.StringType()), ("label_included", T.IntegerType()), ("asreview_label", T.IntegerType()), ("asreview_time", T.DoubleType()))])
CORPUS = "id string, title string, referenced_works array<string>, publication_year int"
CSV = {"header": True, "multiLine": True, "escape": '"'}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads matches something."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def load_config(spark: SparkSession, path: str) -> dict:
    """The datasets' configuration, in its order; FileNotFoundError without the file."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def dataset_names(config: dict) -> list[str]:
    return list(config)


def _entry(config: dict, name: str, key: str) -> str:
    if name not in config:
        raise ValueError(f"unknown dataset {name!r}; known are {list(config)}")
    if key not in config[name]:
        raise ValueError(f"dataset {name!r} has no {key}")
    return config[name][key]


def load_papers(spark: SparkSession, config: dict, name: str, folder: str) -> DataFrame:
    """The configured simulation file, with columns by its header; known ones have their types."""
    path = f"{folder}/{_entry(config, name, 'simulation_file')}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    types = {f.name: f.dataType for f in PAPERS}
    raw = spark.read.options(**CSV).csv(path)
    return raw.select(*(F.col(f"`{c}`").cast(types.get(c, T.StringType())).alias(c) for c in raw.columns))


def load_embeddings(spark: SparkSession, vectors: str, metadata: str) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """``(id, embedding)`` and the metadata, from a ``.npy`` matrix or a Parquet table ``(index, embedding)``; two Nones if either cannot be read."""
    if not (exists(spark, vectors) and exists(spark, metadata)):
        return None, None
    try:
        meta = spark.read.option("multiLine", True).json(metadata)
        rows = read_npy(spark, vectors) if vectors.endswith(".npy") else spark.read.parquet(vectors).select("index", "embedding")
        return rows.join(id_index(meta), "index").select(F.col("openalex_id").alias("id"), "embedding"), meta
    except (AnalysisException, ValueError):
        return None, None


def read_npy(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``(index, embedding)`` of a two-dimensional ``.npy`` file. Rows with missing values have null; a broken header raises ValueError at once.

    Ranges of ``range_bytes`` are read side by side (``sources/npy.py``). On a file system that Spark reads but Arrow does not, the file, up to 2 GB, is one task's work.
    """
    try:
        npy.arrow_path(path)
    except ValueError:
        return _read_whole_npy(spark, path)
    npy.read_header(path)
    spark.dataSource.register(npy.NpyDataSource)
    return spark.read.format("npy").option("rangeBytes", str(range_bytes or npy.RANGE_BYTES)).load(path)


def _read_whole_npy(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    npy.parse_header(bytes(raw.select(F.substring("content", 1, 1 << 16)).first()[0]))

    def kernel(batches):
        for batch in batches:
            for data in batch.column("content"):
                header = npy.parse_header(data.as_buffer().slice(0, min(1 << 16, data.as_buffer().size)).to_pybytes())
                rows = np.frombuffer(data.as_buffer(), header.kind, header.rows * header.columns, header.start)
                yield from npy.matrix_batches(rows.reshape(header.rows, header.columns), 0)

    return raw.select("content").mapInArrow(kernel, "index bigint, embedding array<float>")


def id_index(meta: DataFrame) -> DataFrame:
    """``(openalex_id, index)`` of any layout of the metadata, a list of documents, a list of ids or a row for each; of repeated ids the last."""
    if "index" in meta.columns:
        pairs = meta.select("openalex_id", F.col("index").cast("long").alias("index"))
    elif "documents" in meta.columns:
        pairs = meta.select(F.posexplode("documents").alias("p", "d")).select(F.col("d.openalex_id").alias("openalex_id"), F.col("p").cast("long").alias("index"))
    else:
        pairs = meta.select(F.posexplode("openalex_id").alias("index", "openalex_id")).select("openalex_id", F.col("index").cast("long").alias("index"))
    return pairs.where("openalex_id is not null").groupBy("openalex_id").agg(F.max("index").alias("index"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame | None:
    """Identifier, title, references and year of a corpus; None if it cannot be read."""
    try:
        return spark.read.schema(CORPUS).json(path) if path.endswith(("json", "jsonl")) else spark.read.parquet(path).select("id", "title", "referenced_works", "publication_year")
    except AnalysisException:
        return None


def load_csv(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.options(**CSV).csv(path)
    except AnalysisException:
        return None


def load_documents(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A CSV of documents, its first rows in the order of the files if asked, with the columns that look like title and abstract named so."""
    raw = spark.read.options(**CSV).csv(path)
    # a file that is read line by line across line breaks is one task's, so that its rows are numbered in their order; files go by name
    place = [F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")]
    rows = raw.select(F.struct(*(F.col(f"`{c}`") for c in raw.columns)).alias("row"), *place).orderBy("file", "line").limit(limit).select("row.*") if limit else raw
    for name in ("title", "abstract"):
        found = resolve_like(rows, name)
        if name not in rows.columns and found:
            rows = rows.withColumnRenamed(found, name)
    return rows


def with_record_ids(rows: DataFrame, *order: str) -> DataFrame:
    """``record_id`` from 0, in the order of the named columns."""
    from ..plans.order import with_position

    return with_position(rows, *(F.col(c) for c in order), name="record_id")


def list_datasets(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Names of the files of a folder, sorted."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) or []
    return sorted(s.getPath().getName()[: -len(suffix)] for s in found)


#: Fixed value: the prefix of datasets of the benchmark collection, which lie in a folder of that name.
COLLECTION = "synergy"


def resolve_dataset(spark: SparkSession, name: str, folder: str, config: dict | None = None) -> DataFrame:
    """The first that is there: a table, Parquet folder or CSV file of the name; in the collection, one of the identifier that the configuration
    gives for it; in the collection, one of the name; a file of the identifier; the name as a path. A name may have the collection's prefix itself."""
    known = (config or {}).get(name, {}).get("synergy_dataset_name")
    tries = [name, *([f"{COLLECTION}:{known}"] if known else []), f"{COLLECTION}:{name}", *([known] if known else [])]
    for own in tries:
        prefix, colon, rest = own.partition(":")
        place = f"{folder}/{COLLECTION}/{rest}" if colon and prefix == COLLECTION else f"{folder}/{own}"
        if own.replace("_", "").replace(".", "").isalnum() and spark.catalog.tableExists(own):
            return spark.table(own)
        for path, read in ((f"{place}.parquet", spark.read.parquet), (f"{place}.csv", spark.read.options(**CSV).csv)):
            if ":" not in path.removeprefix(folder) and exists(spark, path):
                return read(path)
    if ":" not in name and exists(spark, name):
        return spark.read.parquet(name)
    raise FileNotFoundError(name)


def availability(spark: SparkSession, config: dict, name: str, folder: str) -> dict[str, bool]:
    """Which of a dataset's configured files are there."""
    own = config.get(name, {})
    keys = {"simulation_data": "simulation_file", "embeddings": "embeddings_filename", "embeddings_metadata": "embeddings_metadata_filename"}
    return {k: bool(own.get(f)) and exists(spark, f"{folder}/{own[f]}") for k, f in keys.items()}


def validate(spark: SparkSession, config: dict, name: str, folder: str) -> bool:
    """Whether a dataset can be analysed: configured, there, with ids and labels, and one relevant paper."""
    try:
        rows = load_papers(spark, config, name, folder)
        return {"openalex_id", "label_included"} <= set(rows.columns) and (rows.agg(F.sum(F.col("label_included"))).first()[0] or 0) >= 1
    except (ValueError, FileNotFoundError, AnalysisException):
        return False


def outlier_ids(spark: SparkSession, config: dict, name: str) -> DataFrame:
    """``position, record_id`` of a dataset's known outliers; none if it is unknown."""
    rows = list(enumerate(config.get(name, {}).get("outlier_ids", [])))
    return spark.createDataFrame(rows, "position long, record_id long")


def embedding_summary(rows: DataFrame, text_columns: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows with texts cut to 100 characters, and one row of totals: documents, valid ones, mean and deviation of their length."""
    valid = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    shown = rows.select(*(F.substring(c, 1, 100).alias(c) if c in text_columns else F.col(c) for c in rows.columns), F.coalesce(valid, F.lit(False)).alias("has_embedding"))
    length = F.when(valid, norm(F.col("embedding")))
    totals = rows.agg(F.count("*").alias("num_documents"), F.count_if(valid).alias("valid_embeddings"), F.max(F.size("embedding")).alias("embedding_dim"), F.avg(length).alias("mean_norm"), F.stddev_pop(length).alias("std_norm"))
    return shown, totals


def save_embeddings(rows: DataFrame, path: str, text_columns: list[str] = ()) -> None:
    shown, totals = embedding_summary(rows, list(text_columns))
    shown.write.mode("overwrite").parquet(f"{path}/vectors")
    totals.write.mode("overwrite").json(f"{path}/summary")


def save_results(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_results(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.json(f"{path}/{n}") for n in names}


def save_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Rows of a report in text.
REPORT_ROWS = 1000


def text_report(df: DataFrame, title: str) -> str:
    """A small table as text; ValueError if it has more than ``REPORT_ROWS`` rows, as nothing is left out."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report in text has {REPORT_ROWS} rows at most")
    return "\n".join([title, "=" * len(title), *(", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in rows)])


def sectioned_report(title: str, sections: dict[str, DataFrame]) -> str:
    """Small tables under headings as one text; a table without rows says so, and each has the bound of ``text_report``."""
    parts = [title, "=" * len(title)]
    for heading, df in sections.items():
        found = text_report(df, heading).split("\n")
        parts += ["", heading, "-" * len(heading), *(found[2:] or ["none"])]
    return "\n".join(parts)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one text file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Batches of an encoder whose texts and vectors a task holds as Python objects.
ENCODED = 8


def encode(texts: DataFrame, encoder, id_col: str = "id", text_col: str = "text", batch: int = 16) -> DataFrame:
    """``(id_col, embedding)`` by any callable from a list of texts to a matrix; null texts have null. The encoder is sent to executors."""
    kind = texts.schema[id_col].dataType.simpleString()

    def kernel(batches):
        import pyarrow as pa

        for rows in (x.slice(low, ENCODED * batch) for x in batches for low in range(0, x.num_rows, ENCODED * batch)):
            words = rows.column("t").to_pylist()
            out = [None] * len(words)
            full = [i for i, w in enumerate(words) if w is not None]
            for at in range(0, len(full), batch):
                some = full[at : at + batch]
                for i, v in zip(some, encoder([words[i] for i in some])):
                    out[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([rows.column("k"), pa.array(out, pa.list_(pa.float32()))], [id_col, "embedding"])

    return texts.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(kernel, f"`{id_col}` {kind}, embedding array<float>")


def hashing_encoder(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a language model: signed word hashes, of length 1."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dim
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        length = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / length for x in v])
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
