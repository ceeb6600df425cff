"""Token counts with a digest cache.

A document's key is the digest of its normalised content, and a count is stored under that key and the digest of the
tokenizer's version (library, its version, and the bytes of the vocabulary file). Documents are joined to the stored
counts by both; only distinct contents that have none are encoded, and their counts are appended to the cache, which is a
Parquet table of (tokenizer, content, n_tokens) that later runs and other corpora share.

Normalising never changes a count: a null text is empty; under a tokenizer whose normaliser lower-cases and folds white
space by itself, ASCII texts without an opening of a special token are lower-cased, and runs of white space become one
space. All other texts are their own content.

The digests (32 bytes a document) are all that is joined; a text moves only if its content is missing, compressed, and
once for each task that holds it, so a third of all documents being copies of one text are one row a task. Digests that
many documents share are looked up by broadcast of at most 1,000 counts.

Defined cases: null and empty texts have the count of an empty text; ids may be null or repeated, each row gives one row;
whole texts are encoded however long they are; an empty table gives no rows and adds nothing to the cache. A run that
fails before its append has added nothing; two runs that append the same content at once leave two equal rows, of which
readers take one. Only the columns named are used.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import token_files
from trialweave.llm._common import groups_for, released, written
from trialweave.llm.components import looked_up

CACHE = "tokenizer string, content binary, n_tokens long"
LIMIT = 2048


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """The digest of a tokenizer's version: the library, its version, and the file's bytes."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(f"{name} {__import__(name).__version__}\n".encode() + data).hexdigest()


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def _plain_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def folds_case(path: str) -> bool:
    """Whether the tokenizer itself lower-cases and folds white space."""
    return not path.endswith(".model") and token_files._tokenizer(path)[2]


def counts(texts: pa.Array, path: str) -> np.ndarray:
    """The tokens of each text, as the file's library gives them."""
    if path.endswith(".model"):
        return np.array([len(_pieces(path).encode(t)) for t in texts.to_pylist()], np.int64)
    if folds_case(path):
        return token_files.encode(texts, path)[1]
    encoded = _plain_tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
    return np.array([len(e.ids) for e in encoded], np.int64)


def normalised(text: Column, folds: bool) -> Column:
    """The content that decides a text's count."""
    text = F.coalesce(text, F.lit(""))
    if not folds:
        return text
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit("<|"))
    return F.when(plain, F.btrim(F.regexp_replace(F.lower(text), "[ \t\n\x0b\f\r]+", " "))).otherwise(text)


def stored(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """(content, n_tokens) of the cache for this tokenizer, one row for each content; no rows where there is no cache yet."""
    try:
        table = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE)
    return table.where(F.col("tokenizer") == version(path)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _first_of_each(batches):
    """A task's distinct contents, each compressed, with its digest."""
    seen: set[bytes] = set()
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        for piece in token_files.slices(batch, "text"):
            content, text = [], []
            for c, t in zip(piece["content"].to_pylist(), piece["text"], strict=True):
                if c not in seen:
                    seen.add(c)
                    content.append(c)
                    raw = t.as_buffer()
                    text.append(len(raw).to_bytes(8, "little") + (codec.compress(raw, asbytes=True) if len(raw) else b""))
            yield pa.record_batch([pa.array(content, pa.binary()), pa.array(text, pa.binary())], names=["content", "packed"])


def encode_missing(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of ``texts`` (content, packed), whose equal contents lie in one partition: each is encoded once."""

    def run(batches):
        seen: set[bytes] = set()
        codec = pa.Codec("zstd")
        for batch in batches:
            held, content, size = [], [], 0
            for c, p in zip(batch["content"].to_pylist(), batch["packed"], strict=True):
                if c in seen:
                    continue
                seen.add(c)
                data = p.as_buffer()
                n = int.from_bytes(data[:8].to_pybytes(), "little")
                held.append(codec.decompress(data[8:], n, asbytes=True) if n else b"")
                content.append(c)
                size += n
                if size >= token_files.SLICE_BYTES:
                    yield _counted(content, held, path)
                    held, content, size = [], [], 0
            yield _counted(content, held, path)
            released()

    return texts.mapInArrow(run, "content binary, n_tokens long")


def _counted(content: list[bytes], texts: list[bytes], path: str) -> pa.RecordBatch:
    n = counts(pa.array(texts, pa.binary()).cast(pa.string()), path) if texts else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(content, pa.binary()), pa.array(n, pa.int64())], names=["content", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, cache: str, *, limit: int = LIMIT, mb: int = 8) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) of all documents; adds what was missing to the table at ``cache``."""
    spark = docs.sparkSession
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    content = F.unhex(F.sha2(normalised(F.col("text"), folds_case(path)), 256))
    marked = written(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), content.alias("content")))
    known = stored(spark, cache, path)
    missing = written(marked.groupBy("content").agg(F.lit(1).alias("x")).join(known, "content", "left_anti").select("content"))
    texts = whole.select(content.alias("content"), "text").mapInArrow(_first_of_each, "content binary, packed binary")
    # Both sides are dealt out alike, so texts are exchanged once; the hash side is the digests, so they are not sorted.
    n = groups_for(docs, mb)
    asked = texts.repartition(n, "content").join(missing.repartition(n, "content").hint("shuffle_hash"), "content")  # (a semi-join would be pushed below the exchange)
    encode_missing(asked, path).select(F.lit(version(path)).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counted = looked_up(marked, "content", stored(spark, cache, path), "n_tokens")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
