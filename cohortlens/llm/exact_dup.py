"""Exact duplicates by a cuckoo-filter index whose hits are settled on the texts themselves.

``CuckooIndex`` holds live texts.  Its slots carry a 16-bit fingerprint of a digest and the number of the stored entry it
stands for; a lookup reads two buckets of four slots, and an entry with the right fingerprint is only a hit when its digest and
then its bytes are the same.  Texts come and go; when an insertion finds no free slot after many moves, the filter
doubles and is filled anew from the stored digests.

Over a table the index works twice.  In each input task it collapses copies that lie together, so that a group that holds a
third of all rows leaves a task as one text with a count.  What is left is dealt by digest, and one index for each partition settles it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Workspace

LOWER = K.LOWER.tobytes()
#: Bytes of texts that an index holds in an input task, and that a partition of settled texts has at the mean.
HELD = 32 << 20
DEALT = 128 << 20
_LOCAL = "rep bigint, doc_id bigint, row bigint, digest binary, n bigint, top bigint, top_row bigint, n_bytes bigint, text binary"
_CLASSES = "rep bigint, digest binary, keep_id bigint, keep_row bigint, group_size bigint"


class CuckooIndex:
    SLOTS = 4
    MOVES = 200

    def __init__(self, buckets: int = 64):
        self.digests: list[bytes | None] = []
        self.texts: list[bytes | None] = []
        self.free: list[int] = []
        self.bytes = self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * self.SLOTS * buckets))
        self.entries = array("q", bytes(8 * self.SLOTS * buckets))
        self.rest: dict[bytes, list[int]] = {}  # entries that find no slot though most are free: no size would hold them

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 3) & self.mask)

    def find(self, digest: bytes, text: bytes) -> int:
        """The entry of this text, or -1."""
        mark, *buckets = self._places(digest)
        for b in buckets:
            for s in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if self.prints[s] == mark and self.digests[e := self.entries[s]] == digest and self.texts[e] == text:
                    return e
        return next((e for e in self.rest.get(digest, ()) if self.texts[e] == text), -1)

    def insert(self, digest: bytes, text: bytes) -> int:
        """A new entry for a text that find() does not know."""
        if self.free:
            e = self.free.pop()
            self.digests[e], self.texts[e] = digest, text
        else:
            e = len(self.digests)
            self.digests.append(digest)
            self.texts.append(text)
        self.bytes += len(text)
        if not self._settled(e):
            self._resize()
        return e

    def delete(self, digest: bytes, text: bytes) -> bool:
        """Takes a text out again; False if it is not there."""
        if (e := self.find(digest, text)) < 0:
            return False
        mark, *buckets = self._places(digest)
        slot = next((s for b in buckets for s in range(b * self.SLOTS, (b + 1) * self.SLOTS) if self.prints[s] == mark and self.entries[s] == e), None)
        if slot is None:
            self.rest[digest].remove(e)
        else:
            self.prints[slot] = 0
        self.digests[e] = self.texts[e] = None
        self.free.append(e)
        self.bytes -= len(text)
        return True

    def live(self) -> Iterator[int]:
        return (e for e, d in enumerate(self.digests) if d is not None)

    def _put(self, bucket: int, mark: int, e: int) -> bool:
        for s in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
            if not self.prints[s]:
                self.prints[s], self.entries[s] = mark, e
                return True
        return False

    def _place(self, e: int) -> int:
        """Finds a slot for an entry by moving others; the entry that is without one in the end, or -1."""
        mark, first, bucket = self._places(self.digests[e])
        if self._put(first, mark, e) or self._put(bucket, mark, e):
            return -1
        for i in range(self.MOVES):
            s = bucket * self.SLOTS + (i * 7 + mark) % self.SLOTS  # another slot each time
            moved, self.prints[s] = self.prints[s], mark
            e, self.entries[s] = self.entries[s], e
            mark, bucket = moved, self._other(bucket, moved)
            if self._put(bucket, mark, e):
                return -1
        return e

    def _settled(self, e: int) -> bool:
        if (left := self._place(e)) < 0:
            return True
        if 8 * (len(self.digests) - len(self.free)) >= len(self.prints):
            return False
        self.rest.setdefault(self.digests[left], []).append(left)
        return True

    def _resize(self) -> None:
        done = False
        while not done:
            self.resizes += 1
            self._empty(2 * (self.mask + 1))
            done = all(map(self._settled, self.live()))


def _digest(width: int):
    return lambda text: hashlib.sha256(text).digest()[:width].ljust(10, b"\0")


def _arrow(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


_LOCAL_ARROW = {"rep": pa.int64(), "doc_id": pa.int64(), "row": pa.int64(), "digest": pa.binary(), "n": pa.int64(), "top": pa.int64(), "top_row": pa.int64(), "n_bytes": pa.int64(), "text": pa.binary()}


def _later(a: tuple, b: tuple) -> tuple:
    """The larger of two (doc_id, row); a null doc_id is below all."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _collapse(held: int, width: int, together: bool = True):
    """Rows (doc_id, text): one row for each (doc_id, row, rep), and one for each different text with how many rows it stands for and the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row, reps = TaskContext.get().partitionId() << 40, 0, 0
        digest_of = _digest(width)
        index, of = CuckooIndex(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, of
            entries = list(index.live())
            for lo in range(0, len(entries), 256):
                yield _arrow(_LOCAL_ARROW, [(of[e][0], None, None, index.digests[e], of[e][1], *of[e][2], len(index.texts[e]), index.texts[e]) for e in entries[lo : lo + 256]])
            index, of = CuckooIndex(), {}

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = (text.as_py() or b"").translate(LOWER)
                digest = digest_of(text)
                if index.bytes > held or len(of) > 1 << 18:
                    yield from flush()
                e = index.find(digest, text) if together else -1
                if e < 0:
                    e = index.insert(digest, text)
                    of[e] = (base + reps, 0, (None, -1))
                    reps += 1
                rep, n, top = of[e]
                of[e] = (rep, n + 1, _later(top, (doc, base + row)))
                out.append((rep, doc, base + row, None, None, None, None, None, None))
                row += 1
            yield _arrow(_LOCAL_ARROW, out)
        yield from flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each text of a partition that holds all texts of its digests."""
    index, of, reps = CuckooIndex(), {}, array("q")
    which = array("q")
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(5)]
        for rep, digest, n, top, top_row, text in zip(*cols, batch.column(5), strict=True):
            text = text.as_py()
            e = index.find(digest, text)
            if e < 0:
                e = index.insert(digest, text)
                of[e] = (0, (None, -1))
            of[e] = (of[e][0] + n, _later(of[e][1], (top, top_row)))
            reps.append(rep)
            which.append(e)
    schema = {"rep": pa.int64(), "digest": pa.binary(), "keep_id": pa.int64(), "keep_row": pa.int64(), "group_size": pa.int64()}
    for lo in range(0, len(reps), 8192):
        some = which[lo : lo + 8192]
        yield _arrow(schema, [(r, index_digest(index, e), *of[e][1], of[e][0]) for r, e in zip(reps[lo : lo + 8192], some, strict=True)])


def index_digest(index: CuckooIndex, e: int) -> bytes:
    """sha256 of an entry's text, also where the index works with shorter digests."""
    d = index.digests[e]
    return d if len(d) == 32 else hashlib.sha256(index.texts[e]).digest()


def _dealt(reps: DataFrame) -> DataFrame:
    """Texts dealt by digest over partitions of about DEALT bytes."""
    spark = reps.sparkSession
    total = reps.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DEALT))
    return reps.repartition(n, "digest")


def exact_groups(docs: DataFrame, width: int = 32, held: int = HELD) -> DataFrame:
    """Groups of documents whose texts are the same after lower-casing A-Z.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.  A null text counts as empty.  Of a
    group the row with the largest doc_id stays, a null doc_id being below all; of several such rows, which are copies in both
    columns, one stays.  keep_id is null where all ids of a group are.  Other columns are ignored.

    width: bytes of the digest that the index works with; texts are compared in any case.
    held: bytes of texts after which an input task passes on what it has collapsed.
    """
    ws = Workspace(docs.sparkSession, "exact")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = ws.keep(texts.mapInArrow(_collapse(held, width), _LOCAL), "local")
    reps = local.filter("n is not null")
    classes = _dealt(reps).select("rep", "digest", "n", "top", "top_row", "text").mapInArrow(_settle, _CLASSES)
    rows = local.filter("n is null").select("rep", "doc_id", "row").join(classes, "rep")
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))



def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Live rows, then withdrawals, then arrivals, of the digests of one partition; gives what lives afterwards."""
    index, ids = CuckooIndex(), {}
    for batch in batches:
        for kind, digest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            e = index.find(digest, text)
            if kind == 1:
                if e >= 0 and ids[e] == doc:
                    index.delete(digest, text)
                    del ids[e]
            elif e < 0:
                ids[index.insert(digest, text)] = doc
            else:
                ids[e] = _later((ids[e], 0), (doc, 0))[0]
    schema = {"digest": pa.binary(), "doc_id": pa.int64(), "text": pa.binary()}
    entries = list(index.live())
    for lo in range(0, len(entries), 256):
        yield _arrow(schema, [(index.digests[e], ids[e], index.texts[e]) for e in entries[lo : lo + 256]])


def update_index(live: DataFrame | None, arrivals: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
    """The live texts (digest, doc_id, text) after a batch: withdrawn documents go, then arrivals come.

    live is what an earlier call gave, None at first.  An arrival whose text lives already changes only its doc_id, to the larger one.  A withdrawal
    (doc_id, text) takes a text out if it lives under that doc_id, so that a later copy of it is new again; one that is not there changes
    nothing.  Texts are lower-cased (A-Z); null counts as empty.
    """
    spark = arrivals.sparkSession
    two = lambda df: df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ws = Workspace(spark, "exact-index")
    pick = lambda df, kind: df.filter("n is not null").select(F.lit(kind).alias("kind"), "digest", F.col("top").alias("doc_id"), "text", "n_bytes")
    rows = pick(two(arrivals).mapInArrow(_collapse(HELD, 32), _LOCAL), 2)
    if withdrawn is not None:
        rows = rows.union(pick(two(withdrawn).mapInArrow(_collapse(HELD, 32, together=False), _LOCAL), 1))
    if live is not None:
        rows = rows.union(live.select(F.lit(0), "digest", "doc_id", "text", F.octet_length("text").cast("bigint")))
    rows = _dealt(ws.keep(rows, "changes")).sortWithinPartitions("kind").select("kind", "digest", "doc_id", "text")
    return ws.keep(rows.mapInArrow(_apply, "digest binary, doc_id bigint, text binary"), "live")


def op13_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all ``documents``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
