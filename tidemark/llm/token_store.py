"""A store of token ids: each document compressed on its own under one shared zstandard dictionary.

A store is a folder with three Parquet tables. `format` says how wide ids are, where the buckets' edges lie and whether there is a
dictionary (a sample that is too small gives none). `dictionary` has one row: the dictionary's bytes and their SHA-256.
`shards` has a row for each run of documents in ascending id order: bucket and seq (the shard's place), the
dictionary's hash, base (ids before the shard within its bucket), and, for each document, its id, its number of
token ids and its offset into payload, the concatenated frames. A short document is read by one slice of payload.
Token ids are serialized as little-endian unsigned 16- or 32-bit integers, whichever the largest id needs.

Buckets are ranges of ids between quantiles (at most MOST_BUCKETS, a bounded table); rows with one id, or without one,
share a bucket, as their place is one after another; a shard closes at SHARD_BYTES of payload, so no row grows with the input.

Defined cases: a null text is empty (it still has its end id); null ids come first; rows with the same id are ordered
by their token ids; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hashed_sample
from .tokens import encoder

SAMPLE = 500  # documents that the dictionary is trained on, about, chosen by a hash of their id
DICTIONARY_BYTES = 32_768
MOST_BUCKETS = 4096
PER_BUCKET = 4000
SHARD_BYTES = 8_000_000


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """From a bounded sample; empty if zstandard refuses it as too small, which the store's `format` table then says."""
    few = hashed_sample(docs.select(id_col, text_col), SAMPLE).select(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 20_000).alias("t"))
    encode = encoder(tokenizer).one
    arrays = [_narrow(np.frombuffer(encode(t), "<u4"), True) for t in sorted(r.t for r in few.collect())]
    arrays = [x for x in arrays if len(x) > 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _narrow(ids: np.ndarray, short: bool) -> bytes:
    return ids.astype("<u2" if short else "<u4").tobytes()


def _frames(dictionary: bytes, tokenizer: str, edges: list[int], end_id: int, short: bool):
    """Batches of (id, text) -> (bucket, id, n_tokens, frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer).one, np.array([end_id], "<u4").tobytes()
        pack = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 500):
                counts, frames = [], []
                for t in texts[lo : lo + 500].to_pylist():
                    tokens = encode(t or "") + last
                    counts.append(len(tokens) // 4)
                    frames.append(pack.compress(_narrow(np.frombuffer(tokens, "<u4"), short)))
                own = ids[lo : lo + 500]
                bucket = np.searchsorted(edges, own.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), own, pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["bucket", "id", "n_tokens", "frame"])

    return run


def _shards(digest: str):
    """Frames in order of bucket and id -> shards; holds one shard at a time."""
    names = ["bucket", "seq", "dictionary_sha256", "base", "ids", "n_tokens", "offsets", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, seq, base = None, 0, 0
        held: list[list] = [[], [], []]
        size = 0

        def closed() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in held[2]])]).astype(np.int64)
            row = [bucket, seq, digest, base, held[0], held[1], offsets, b"".join(held[2])]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for b, i, n, frame in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held[0] and (b != bucket or size + len(frame) > SHARD_BYTES):
                    yield closed()
                    seq, base = (seq + 1, base + sum(held[1])) if b == bucket else (0, 0)
                    held, size = [[], [], []], 0
                elif b != bucket:
                    seq, base = 0, 0
                bucket = b
                for to, x in zip(held, (i, n, frame), strict=True):
                    to.append(x)
                size += len(frame)
        if held[0]:
            yield closed()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    spark, work = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(work, tokenizer, "id", "text")
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    marks = [k / MOST_BUCKETS for k in range(1, MOST_BUCKETS)]
    n, found = work.agg(F.count(F.lit(1)), F.percentile_approx("id", marks, 20_000)).first()
    parts = min(MOST_BUCKETS, max(1, n // PER_BUCKET))
    edges = [found[k * MOST_BUCKETS // parts - 1] for k in range(1, parts)] if found else []
    short = encoder(tokenizer).tokenizer.get_vocab_size() <= 65_536
    frames = work.mapInArrow(_frames(dictionary, tokenizer, edges, end_id, short), "bucket int, id long, n_tokens long, frame binary")
    dealt = frames.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "frame")
    schema = "bucket int, seq int, dictionary_sha256 string, base long, ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
    dealt.mapInArrow(_shards(digest), schema).write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(short, end_id, bool(dictionary), edges)], "short boolean, end_id int, has_dictionary boolean, edges array<long>").coalesce(1).write.parquet(f"{path}/format")


def read(spark: SparkSession, path: str) -> DataFrame:
    """-> id, start (ids of all documents before it), n_tokens, tokens (little-endian unsigned 32-bit ids)."""
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, short = bytes(dictionary), spark.read.parquet(f"{path}/format").first().short
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary does not have the hash it was stored with")
    shards = spark.read.parquet(f"{path}/shards")
    sums = shards.select("bucket", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    # at most MOST_BUCKETS + 1 rows: one task orders them, every executor may hold them
    starts = sums.select(F.col("bucket").alias("b"), (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"))
    placed = shards.join(F.broadcast(starts), F.col("bucket") == F.col("b")).select((F.col("start") + F.col("base")).alias("start"), "dictionary_sha256", "ids", "n_tokens", "offsets", "payload")
    kind = "<u2" if short else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                begin = row["start"] + np.concatenate([[0], np.cumsum(row["n_tokens"])[:-1]]).astype(np.int64)
                offsets, payload = row["offsets"], memoryview(row["payload"])
                for lo in range(0, len(row["ids"]), 500):
                    some = range(lo, min(lo + 500, len(row["ids"])))
                    tokens = [np.frombuffer(unpack.decompress(payload[offsets[k] : offsets[k + 1]]), kind).astype("<u4").tobytes() for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"][k] for k in some], pa.int64()), pa.array(begin[lo : lo + 500], pa.int64()), pa.array([row["n_tokens"][k] for k in some], pa.int64()), pa.array(tokens, pa.binary())], ["id", "start", "n_tokens", "tokens"])

    return placed.mapInArrow(run, "id long, start long, n_tokens long, tokens binary")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """-> id, n_tokens, tokens of the stored documents that have one of the ids; a null among them asks for rows without an id.

    The edges say which buckets can hold the ids; the filter on them goes to the Parquet scan, whose statistics leave out the payload
    of other buckets. Of the shards that stay, only the slices of the wanted documents are decompressed.
    """
    form, (digest, dictionary) = spark.read.parquet(f"{path}/format").first(), spark.read.parquet(f"{path}/dictionary").first()
    buckets = np.unique(np.searchsorted(np.array(form.edges, np.int64), [-(2**63) if i is None else i for i in ids], side="right")).tolist()
    shards = spark.read.parquet(f"{path}/shards").filter(F.col("bucket").isin(buckets)).select("dictionary_sha256", "ids", "n_tokens", "offsets", "payload")
    kind, wanted, dictionary = "<u2" if form.short else "<u4", set(ids), bytes(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                places = [k for k, i in enumerate(row["ids"]) if i in wanted]
                offsets, payload = row["offsets"], memoryview(row["payload"])
                for lo in range(0, len(places), 500):
                    some = places[lo : lo + 500]
                    tokens = [np.frombuffer(unpack.decompress(payload[offsets[k] : offsets[k + 1]]), kind).astype("<u4").tobytes() for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([row["ids"][k] for k in some], pa.int64()), pa.array([row["n_tokens"][k] for k in some], pa.int64()), pa.array(tokens, pa.binary())], ["id", "n_tokens", "tokens"])

    return shards.mapInArrow(run, "id long, n_tokens long, tokens binary")


def checksum(tokens: bytes) -> int:
    return zlib.crc32(tokens)
