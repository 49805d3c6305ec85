"""Token counts of whole texts, through a cache of counts by digest.

1. Every text gets the SHA-256 digest of its normalised content, and the
   tokenizer one of its version: library, library version and model file.
2. The distinct digests are joined to the counts that the cache holds for this
   version.  Of the digests that it lacks, each task passes on one text each,
   one of these is kept, encoded with the tokenizer's own library, and its
   count is appended to the cache.
3. Every row is joined to the count of its digest.

Normalising only makes one content of what the library cannot tell apart in
any tokenizer: a null text is the empty one.  Folding letters or white space
would not be safe (special strings are matched before a tokenizer's own
normaliser), so it is left to a caller who knows the tokenizer, as a function
of the text column; the first normalised text is then what gets encoded.

The cache is a folder of Parquet files with one folder for each version:
``content`` (digest), ``n_tokens``.  Appending twice, or by two jobs at a time,
gives repeated rows with equal counts, which are read as one; a job that fails
leaves no rows or whole ones, and run again it encodes what is still missing.

Cases: null and empty texts have 0 bytes and the count of the empty text; a
text of any length is encoded whole; repeated rows each get their row and are
encoded once; an empty table gives an empty result and appends nothing; null
ids are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.session import ensure_checkpoint_dir

from .common import col, fresh, staged, text_blocks

TOKEN_LIMIT = 4096
CACHE_SCHEMA = "content string, n_tokens bigint"


class Tokenizer:
    """A tokenizer file, read once on the driver and sent with the tasks:
    ``.json`` for the tokenizers library, ``.model`` for sentencepiece."""

    def __init__(self, path: str):
        self.kind = path.rsplit(".", 1)[-1]
        if self.kind not in ("json", "model"):
            raise ValueError(f"neither a .json nor a .model file: {path}")
        with open(path, "rb") as f:
            self.file = f.read()

    def version(self) -> str:
        """A digest that changes with the file, the library and its version."""
        import sentencepiece
        import tokenizers

        library = tokenizers if self.kind == "json" else sentencepiece
        about = f"{library.__name__} {library.__version__}\n".encode()
        return hashlib.sha256(about + self.file).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Counts of a list of texts, without begin, end or added special
        tokens, truncation or padding."""
        if self.kind == "json":
            from tokenizers import Tokenizer as Library

            library = Library.from_str(self.file.decode("utf-8"))
            library.no_truncation()
            library.no_padding()
            return lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.file)
        return lambda texts: [len(ids) for ids in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def worker_counter(tokenizer: Tokenizer, version: str) -> Callable[[list[str]], list[int]]:
    """The counter of this version, made once in a Python worker."""
    if version not in _counters:
        _counters[version] = tokenizer.counter()
    return _counters[version]


class TokenCache:
    """Counts by tokenizer version and content digest, in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folder(self, version: str) -> str:
        return f"{self.path}/tokenizer={version}"

    def counts(self, version: str) -> DataFrame:
        """(content, n_tokens), one row for each content."""
        folder = self.folder(version)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(folder) if there else self.spark.createDataFrame([], CACHE_SCHEMA)
        return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.write.mode("append").parquet(self.folder(version))


def once_a_task(rows: DataFrame) -> DataFrame:
    """(content, text): the first text of each content in each task, so copies
    do not all travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k, content in enumerate(batch.column(0).to_pylist()):
                digest = bytes.fromhex(content)
                if digest not in seen:
                    seen.add(digest)
                    keep.append(k)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def encode(texts: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(content, n_tokens) of (content, text)."""
    version = tokenizer.version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_counter(tokenizer, version)
        for batch in batches:
            for lo, hi, block in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count(block.texts()), pa.int64())],
                                                 names=["content", "n_tokens"])

    return texts.mapInArrow(run, CACHE_SCHEMA)


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = TOKEN_LIMIT,
                 normalise: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """Per row: the id, n_bytes (UTF-8), n_tokens and over_limit (more than
    ``limit`` tokens).  Without ``cache_path`` the cache is a new, empty folder
    under ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    tokenizer = Tokenizer(tokenizer_path)
    version = tokenizer.version()
    cache = TokenCache(spark, cache_path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-token-cache-{uuid.uuid4().hex}")
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    content = F.sha2(F.coalesce(normalise(text), F.lit("")), 256)
    names = []
    for name in ("n_bytes", "n_tokens", "over_limit"):
        names.append(fresh(name, [id_col, *names]))
    key = fresh("content", [id_col, *names])
    rows = staged(df.select(col(id_col), F.octet_length(text).cast("bigint").alias(names[0]), content.alias(key)), "token-rows")

    digests = rows.select(F.col(key).alias("content")).distinct()
    missing = digests.join(cache.counts(version), "content", "left_anti")
    texts = once_a_task(df.select(content.alias("content"), F.coalesce(normalise(text), F.lit("")).alias("text")))
    chosen = texts.join(missing, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    cache.append(encode(chosen, tokenizer), version)

    # Two written tables meet in this join, so adaptive execution can split a
    # content that many rows share.
    counts = staged(digests.join(cache.counts(version), "content").select(
        F.col("content").alias(key), F.col("n_tokens").alias(names[1])), "token-counts")
    return rows.join(counts, key).select(col(id_col), names[0], names[1], (F.col(names[1]) > limit).alias(names[2]))
