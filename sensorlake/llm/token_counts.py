"""Token counts with a digest cache.

A cache table holds token counts by version of the tokenizer (library, release,
digest of the file) and digest of the content. Documents join it by digest; only
contents that it lacks are encoded, each distinct one once, and their counts are
appended.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm import scratch, skew, words

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
#: Bytes of text that are encoded in one call.
CALL_BYTES = 4 << 20


@cache
def version(tokenizer: str) -> str:
    """The library that reads the tokenizer file, its release, and a digest of the file."""
    with open(tokenizer, "rb") as file:
        body = hashlib.sha256(file.read()).hexdigest()
    library = importlib.import_module("sentencepiece" if tokenizer.endswith(".model") else "tokenizers")
    return f"{library.__name__}:{library.__version__}:{body}"


@cache
def _counter(tokenizer: str):
    if tokenizer.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def content(text: Column) -> Column:
    """The content that is counted: the text as it is, null as empty."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(content(text).cast("binary"), 256)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at path; empty if there is none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def encoded(misses: DataFrame, tokenizer: str) -> DataFrame:
    """For distinct rows (digest, text): rows of the cache.

    A task whose tokenizer is of another version than the driver's fails.
    """
    name = version(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version(tokenizer) != name:
            raise ValueError(f"the driver has {name}, this machine {version(tokenizer)}")
        count = _counter(tokenizer)
        for batch in batches:
            _, places = words.utf8(batch.column("text"))
            for low, high in words.chunks(places, CALL_BYTES):
                part = batch.slice(low, high - low)
                counts = count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(counts), pa.string()), part.column("digest"), pa.array(counts, pa.int64())],
                    names=["tokenizer", "digest", "n_tokens"],
                )

    return misses.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count(docs: DataFrame, tokenizer: str, cache_path: str, text: str = "text") -> DataFrame:
    """Every row with its columns and n_bytes, n_tokens (long).

    tokenizer: the path of a .json or .model file, present on every machine.
    cache_path: the cache table, which grows by the contents it lacked. Null
    counts as the empty text, of 0 bytes. Repeated texts are encoded once and
    get equal counts. Columns called like a result are replaced by it.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    body = F.col(f"row.`{text}`")
    known = open_cache(spark, cache_path).where(F.col("tokenizer") == version(tokenizer)).select("digest")
    texts = held.select(digest(body).alias("digest"), content(body).alias("text"))
    rows = scratch.save(texts.groupBy("digest").agg(F.count("*").alias("copies")), f"{scratch.folder(spark)}/rows")
    misses = texts.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    with scratch.freed(spark):
        encoded(misses, tokenizer).write.mode("append").parquet(cache_path)
    counts = open_cache(spark, cache_path).where(F.col("tokenizer") == version(tokenizer))
    # two runs at a time may both have appended a digest
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = counts.join(rows, "digest")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    keyed = held.select("row", digest(body).alias("digest"), F.octet_length(content(body)).cast("long").alias("n_bytes"))
    other = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))  # no digest has a blank
    both = skew.beside(keyed, counts, "digest", "copies", total, other)
    return both.select("row.*", "n_bytes", "found.n_tokens")
