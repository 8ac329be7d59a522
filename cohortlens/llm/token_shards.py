"""Training-order materialisation of token sequences.

Texts become sequences of ``length`` token ids, the last of a text padded.  The sequences are numbered without gaps and a
keyed Feistel permutation, walking its cycles back into range, gives each number its slot in training order.  Ranges of slots are
shards, one raw file each in order of slots.  Every record takes ``stride(length)`` bytes, so that slot n begins at byte n % per_shard times
the stride of its shard; a reader goes through the files in sequence and resumes at any slot with one seek.

Texts are tokenised twice, once to count and once to write: that needs no intermediate table as large as the output.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256  # ends each text and fills its last sequence
NO_ID = -(1 << 63)
#: Before a record's ids: doc_id, sequence of its text and number of ids that are the text's; after them a line feed, which Spark's writer puts between records.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<u2")])


def stride(length: int) -> int:
    """Bytes of a record of ``length`` ids."""
    return HEADER.itemsize + 2 * length + 1


def tokenizer(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if b}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def permute(number: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Slots of numbers below n: a balanced Feistel network over the next even number of bits, repeated while it leads outside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = K.mix(np.arange(1, rounds + 1, dtype=np.uint64) + K.U64(key))
    out = number.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (K.mix(right ^ k) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def _counts(vocabulary, length: int):
    """(file, block, n): sequences of each piece of a file that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary.value).encode_ordinary
        for batch in batches:
            n: dict[tuple, int] = {}
            for text, at in zip(batch.column(1), zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), strict=True):
                text = text.as_py()
                n[at] = n.get(at, 0) + (len(encode(text)) // length + 1 if text else 0)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in n], pa.string()), pa.array([b for _, b in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["file", "block", "n"])

    return run


def _records(vocabulary, length: int, shared, per_shard: int):
    """(shard, slot, record) of each sequence; the numbers of a piece of a file follow one another from its place in ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary.value).encode_ordinary
        begins, total, key = shared.value
        upto: dict[tuple, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                numbers, rows = [], []
                part = batch.slice(lo, 256)
                for doc, text, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True), strict=True):
                    if not text:
                        continue
                    ids = np.array(encode(text), np.uint16)
                    n = len(ids) // length + 1  # room for one END at least
                    made = np.zeros((n, HEADER.itemsize + 2 * length), np.uint8)
                    padded = np.full(n * length, END, "<u2")
                    padded[: len(ids)] = ids
                    made[:, HEADER.itemsize :] = padded.view(np.uint8).reshape(n, -1)
                    told = np.zeros(n, HEADER)
                    told["doc_id"], told["seq"], told["n_tokens"] = NO_ID if doc is None else doc, np.arange(n), length
                    told["n_tokens"][-1] = len(ids) - (n - 1) * length
                    made[:, : HEADER.itemsize] = told.view(np.uint8).reshape(n, -1)
                    first = upto.get(at, begins[at])
                    numbers.append(np.arange(first, first + n))
                    upto[at] = first + n
                    rows.append(made)
                if not rows:
                    continue
                slot = permute(np.concatenate(numbers), total, key)
                flat = np.concatenate(rows)
                where = pa.py_buffer((np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.Array.from_buffers(pa.binary(), len(flat), [None, where, pa.py_buffer(flat.tobytes())])], names=["shard", "slot", "record"])

    return run


def _in_files(docs: DataFrame, by_key: bool) -> DataFrame:
    """(doc_id, text, file, block) of docs; from a sorted copy of it by_key, or where docs isn't read from files."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    if not by_key:
        try:
            return docs.select(*(docs[c].cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))), *place)
        except AnalysisException:
            pass
    ws, spark = Workspace(docs.sparkSession, "tokens"), docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    texts.repartitionByRange(*order).sortWithinPartitions(*order, "text").write.mode("overwrite").parquet(ws.path("ordered"))
    return spark.read.schema(texts.schema).parquet(ws.path("ordered")).select("doc_id", "text", *place)


def write_shards(docs: DataFrame, path: str, length: int = 256, per_shard: int = 32768, key: int = 20260101, vocabulary: str | None = None, by_key: bool = False) -> DataFrame:
    """Writes docs as shards under ``path``, with a manifest, and returns what read_shards gives.

    A record holds ``length`` little-endian 16-bit ids; n_tokens of them are the text's, the others END.  A text
    of n tokens has n // length + 1 sequences, in seq's order.  A null or empty text has none.  Repeated rows are separate texts.  Other columns are ignored.

    Sequences are numbered in the order of the files that docs is read from, however these are split over tasks.  With ``by_key``, and where docs isn't read
    from files, they are numbered in order of doc_id (null last), the text's hash and the text, so that the same rows give the same
    bytes in any files and partitions; that writes a sorted copy of the texts first.

    vocabulary: a file of token ranks; else that of the session's setting spark.cohortlens.vocabulary, else VOCABULARY.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    with open(vocabulary or spark.conf.get("spark.cohortlens.vocabulary", VOCABULARY), "rb") as f:
        words = sc.broadcast(f.read())
    pin = "spark.sql.files.minPartitionNum"  # both scans split files alike, also if executors are lost between them
    before = spark.conf.get(pin, None)
    spark.conf.set(pin, before or str(sc.defaultParallelism))
    try:
        texts = _in_files(docs, by_key)
        pieces = texts.mapInArrow(_counts(words, length), "file string, block bigint, n bigint").groupBy("file", "block").agg(F.sum("n").alias("n"))
        begins, n = {}, 0
        for r in sorted(pieces.collect()):  # one row for each piece of a file that a task reads
            begins[r["file"], r["block"]] = n
            n += r["n"]
        made = texts.mapInArrow(_records(words, length, sc.broadcast((begins, n, key)), per_shard), "shard int, slot bigint, record binary")
        dealt = made.repartitionById(max(1, -(-n // per_shard)), "shard").sortWithinPartitions("slot")  # ranges of slots
        dealt.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").mode("overwrite").text(path)
    finally:
        spark.conf.set(pin, before) if before else spark.conf.unset(pin)
    _manifest(spark, path, length, per_shard, key, n)
    return read_shards(spark, path, length, per_shard)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """shard, file and bytes of each shard under path; a task writes one shard under its number."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.withColumn("shard", F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int"))


def _manifest(spark: SparkSession, path: str, length: int, per_shard: int, key: int, n: int) -> None:
    """One row a shard, under path/_manifest, which readers of the shards pass over."""
    files = _files(spark, path).select("shard", F.col("path").alias("file"), F.col("length").alias("bytes"))
    settings = {"sequence_length": length, "stride": stride(length), "per_shard": per_shard, "key": key, "sequences": n}
    files.withColumns({k: F.lit(v).cast("bigint") for k, v in settings.items()}).write.mode("overwrite").parquet(f"{path}/_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_manifest")


def read_shards(spark: SparkSession, path: str, length: int = 256, per_shard: int = 32768, digests: bool = False) -> DataFrame:
    """shard, slot, doc_id, seq, n_tokens, tokens of each record under path; with ``digests`` tokens_sha256 (lowercase hex) instead of tokens."""
    names = ["shard", "slot", "doc_id", "seq", "n_tokens", "tokens_sha256" if digests else "tokens"]
    schema, size = f"shard int, slot bigint, doc_id bigint, seq int, n_tokens int, {'tokens_sha256 string' if digests else 'tokens binary'}", stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, size)
                for lo in range(0, len(raw), 2048):
                    rows = raw[lo : lo + 2048]
                    n = len(rows)
                    told = np.ascontiguousarray(rows[:, : HEADER.itemsize]).view(HEADER)[:, 0]
                    if digests:
                        tokens = pa.array([hashlib.sha256(x[HEADER.itemsize : -1]).hexdigest() for x in rows])
                    else:
                        where = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 2 * length).tobytes())
                        tokens = pa.Array.from_buffers(pa.binary(), n, [None, where, pa.py_buffer(np.ascontiguousarray(rows[:, HEADER.itemsize : -1]).tobytes())])
                    docs = pa.array(told["doc_id"], mask=told["doc_id"] == NO_ID)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(shard * per_shard + lo + np.arange(n)), docs, pa.array(told["seq"]), pa.array(told["n_tokens"].astype(np.int32)), tokens], names=names)

    return _files(spark, path).select("shard", "content").mapInArrow(run, schema)


def sequences_from(manifest: list, slot: int, open_file: Callable = open) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(slot, doc_id, seq, ids of the text) from a slot on, as a training job reads them; manifest: rows of read_manifest.

    open_file opens one of its files for reading bytes, wherever it is stored.
    """
    if not manifest:
        return
    size, per_shard = manifest[0]["stride"], manifest[0]["per_shard"]
    for row in sorted(manifest, key=lambda r: r["shard"]):
        first = row["shard"] * per_shard
        if slot >= first + row["bytes"] // size:
            continue
        with open_file(row["file"].removeprefix("file:"), "rb") as f:
            f.seek((slot - first) * size)
            while record := f.read(size):
                doc, seq, n = np.frombuffer(record, HEADER, 1)[0].tolist()
                yield slot, None if doc == NO_ID else doc, seq, np.frombuffer(record, "<u2", n, HEADER.itemsize)
                slot += 1


def op5_feistel_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as shards of 256-token sequences; a digest of each sequence as it was written."""
    return written_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def written_digests(docs: DataFrame) -> DataFrame:
    """shard, slot, doc_id, seq, n_tokens, tokens_sha256 of docs' shards, read back from where they were written."""
    path = Workspace(docs.sparkSession, "shards").path("shards")
    write_shards(docs, path)
    return read_shards(docs.sparkSession, path, digests=True)
