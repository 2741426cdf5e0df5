"""What the corpus operators share: hashes of words and shingles, connected
components, and joins on keys that may be hot."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import connected
from ..operators.tables import discard, materialize, new_folder

__all__ = ["WORD", "broadcast_if_small", "components", "discard", "join_components", "materialize", "new_folder", "read", "remainder", "schema_of", "shingle_set", "small_batches", "word_hashes"]

#: White space of the word pattern ``[^\x20\x09-\x0D]+`` (the same bytes that ``bytes.split()`` cuts at).
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32(doc_id as text) mod ``by``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % by


#: Bytes of rows that Python gets at once within ``small_batches``; a longer row comes alone.
BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """What is executed within sends rows to Python by ``BATCH_BYTES``, not by 10,000 rows or 64 MB.

    A batch of long texts lies in the executor's memory several times: in
    buffers that double as they fill, and in Python as buffer and as objects.
    A limit that the session has set itself stays.  Plans that are executed
    later, and the whole groups of ``applyInArrow``, are not concerned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name)


# ------------------------------------------------------------ hashes of words
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_TIMES = _mix(np.arange(11, 16, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _hash_words(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[raw] * up[:-1], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z lower-cased.

    Very long texts are hashed in pieces cut at white space, so memory stays
    bounded by the piece and the words themselves.
    """
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(data) <= _PIECE:
        return _hash_words(data)
    out, at = [], 0
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        out.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a whole text.

    With fewer words the whole sequence is one shingle; without words (or
    with a null text) the set is empty.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    k = min(n, width)
    total = w[: n - k + 1] * _TIMES[0]
    for i in range(1, k):
        total = total + w[i : n - k + 1 + i] * _TIMES[i]
    return np.unique(_mix(total + np.uint64(k)))


# ------------------------------------------------------- connected components
#: Rows up to which a counted table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Members from which a component counts as large; there are at most rows / LARGE of these.
LARGE = 1000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows (it is counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node of each component, for the nodes that have an edge; null ends are ignored."""
    return connected(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))


def join_components(members: DataFrame, whole: DataFrame) -> DataFrame:
    """``members(component, ...)`` joined with ``whole(component, members, ...)``, a row for each component with the number of its members.

    One component may hold a third of all rows: the large ones, few by
    definition, are broadcast after they are counted, so that their members
    stay where they are; the others are joined by shuffle.
    """
    names = [c for c in whole.columns if c not in ("component", "members")]
    large = whole.where(F.col("members") >= LARGE).select(F.col("component").alias("_large"), *[F.col(c).alias(f"_{c}") for c in names])
    met = members.join(broadcast_if_small(large), F.col("component") == F.col("_large"), "left")
    mine = members.columns
    out = met.where("_large is not null").select(*mine, *[F.col(f"_{c}").alias(c) for c in names])
    small = whole.where(F.col("members") < LARGE).drop("members")
    return out.unionByName(met.where("_large is null").select(*mine).join(small, "component").select(*mine, *names))


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
