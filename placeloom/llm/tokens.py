"""Training-order materialisation of token ids.

Documents are tokenised whole (ids of a public byte-level BPE, an end-of-text
id after each) and laid end to end; every ``length`` ids form a sequence, the
last one is padded.  A keyed Feistel permutation with cycle-walking over
0..N-1 gives each sequence its global slot, so the training order is a pure
function of the key and needs neither a sort nor a table.  Slots are range
partitioned into shards; a shard is one file of fixed-stride little-endian
records, so slot s lies at byte ``(s mod shard_slots) * length * width`` of
shard ``s div shard_slots``: readers stream it or resume at any slot.

What a job needs to go on lies beside the shards.  The tokenised table
(``_tokens``) is written first and holds the place of every document, so the
layout doesn't depend on how the input is partitioned when the job is resumed;
``manifest.json`` then records key, length, shard size, vocabulary, number of
ids, and a fingerprint of the corpus.  Each shard is written by one task under
a draft name and renamed, after an index file of its slots with a checksum
each.  ``resume`` refuses another corpus or other settings, reads every shard
against its checksums, writes only those that are missing or damaged, and
returns the same rows as an undisturbed run.  Without a manifest nothing of an
earlier run is trusted and all is written anew.

Defined cases: a null text is laid out like an empty one (an end-of-text id
alone); repeated rows are laid out once each; an empty table gives no shard;
null ids are kept as null in ``doc_ids``; very long texts span as many
sequences as they need; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_folder, read, small_batches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
_ENCODERS: dict = {}
#: Texts are encoded in pieces of about so many characters, cut where the pattern always starts a new word.
_PIECE = 1 << 20
_SAFE = re.compile(r"(?<=[^\s]) (?=[^\s])")
_BUFFER = 8 << 20


def encoder(vocabulary: str = DEFAULT_VOCABULARY):
    """The tokenizer of a rank file, kept for each worker process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def encode(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """Ids of a whole text with the end-of-text id; pieces keep the memory of very long texts bounded."""
    enc, text, out, at = encoder(vocabulary), text or "", [], 0
    while at < len(text):
        end = len(text)
        if end - at > _PIECE:
            cut = _SAFE.search(text, at + _PIECE)
            end = cut.start() if cut else end
        out.append(np.array(enc.encode_ordinary(text[at:end]), dtype="<u2"))
        at = end
    return np.concatenate([*out, np.array([END_OF_TEXT], dtype="<u2")])


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of 0..n-1: a balanced Feistel network over the next power of four, walked until the value lies below n."""
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(((key * 0x9E3779B97F4A7C15) ^ (r * 0xD1B54A32D192ED03)) & 0xFFFFFFFFFFFFFFFF) for r in range(1, rounds + 1)]

    def mix(v, k):
        v = (v + k) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (v ^ (v >> np.uint64(32))) & mask

    def once(v):
        left, right = v >> half, v & mask
        if inverse:
            for k in reversed(keys):
                left, right = right ^ mix(left, k), left
        else:
            for k in keys:
                left, right = right, left ^ mix(right, k)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(x, dtype=np.uint64))
        while (out_of := out >= np.uint64(n)).any():
            out[out_of] = once(out[out_of])
    return out.astype(np.int64)


def filesystem(uri: str):
    """(file system, path) of a shared folder; anything that pyarrow can open."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri.removeprefix("file:") if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def _hash(text: str, key: str):
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def tokenised(docs: DataFrame, text: str, key: str, vocabulary: str) -> DataFrame:
    """(block, start, n, doc_id, print, ids): a block is what one task read, ``start`` the position in it, ``print`` a hash of id and text."""

    def run(batches):
        from pyspark import TaskContext

        block, start = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [encode(t, vocabulary) for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            starts = start + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
            start += int(n.sum())
            columns = [pa.array(np.full(len(n), block)), pa.array(starts, pa.int64()), pa.array(n), b.column(0), b.column(2), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "start", "n", "doc_id", "print", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), _hash(text, key).alias("print"))
    return rows.mapInArrow(run, "block long, start long, n long, doc_id long, print long, ids binary")


def _fingerprint(rows: DataFrame, hashed) -> list[str]:
    """Count and order-free sum of the rows' hashes."""
    r = rows.agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("s")).first()
    return [str(r["n"]), str(r["s"])]


def _read_json(uri: str, name: str) -> dict | None:
    store, folder = filesystem(uri)
    if not store.get_file_info(f"{folder}/{name}").is_file:
        return None
    with store.open_input_stream(f"{folder}/{name}") as f:
        return json.loads(f.read())


def _listing(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


def _replace_file(store, folder: str, name: str, data) -> None:
    """Write a file under a draft name and rename it, so that it is whole or absent; a failed draft is removed."""
    from uuid import uuid4

    store.create_dir(f"{folder}/_drafts", recursive=True)
    draft = f"{folder}/_drafts/{name}.{uuid4().hex}"
    try:
        with store.open_output_stream(draft) as f:
            f.write(data)
        store.move(draft, f"{folder}/{name}")
    except BaseException:
        if store.get_file_info(draft).is_file:
            store.delete_file(draft)
        raise


_INDEX = "slot long, sequence long, shard string, offset long, n_ids long, checksum long, doc_ids array<long>"


def _name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _checked(uri: str, shard: int, slots: int, stride: int) -> pa.Table | None:
    """The index of a shard if it and its file are there and every record has its checksum, else None."""
    store, folder = filesystem(uri)
    data, index = f"{folder}/{_name(shard)}", f"{folder}/{_name(shard)}.index"
    if not all(store.get_file_info(x).is_file for x in (data, index)) or store.get_file_info(data).size != slots * stride:
        return None
    try:
        with store.open_input_stream(index) as f:
            table = pa.ipc.open_stream(f.read()).read_all()
    except (pa.ArrowInvalid, OSError):
        return None
    if table.num_rows != slots:
        return None
    with store.open_input_stream(data) as f:
        for crc in table.column("checksum").to_pylist():
            if zlib.crc32(f.read(stride)) != crc:
                return None
    return table


def materialise(
    docs: DataFrame, out: str, text: str = "text", key: str = "doc_id", permutation_key: int = 20240229, length: int = 2048,
    shard_slots: int = 4096, vocabulary: str = DEFAULT_VOCABULARY, resume: bool = False, keep_tokens: bool = True,
) -> DataFrame:
    """Write the shards below ``out`` and return a row for each slot: ``slot, sequence, shard, offset, n_ids, checksum, doc_ids``.

    ``resume`` goes on with a job in the same folder; without it an earlier job
    there is replaced.  ``keep_tokens=False`` deletes the tokenised table at the
    end, after which a resumed job starts from the beginning.
    """
    spark = docs.sparkSession
    store, folder = filesystem(out)
    settings = {"key": sha256(str(permutation_key).encode()).hexdigest(), "length": length, "shard_slots": shard_slots, "vocabulary": vocabulary.rsplit("/", 1)[-1]}
    schema = "block long, start long, n long, doc_id long, print long, ids binary"
    manifest = _read_json(out, "manifest.json") if resume else None
    if manifest:
        other = sorted(k for k, v in settings.items() if manifest["settings"][k] != v)
        if other:
            raise ValueError(f"the job in {out} has other settings: {', '.join(other)}")
        if manifest["corpus"] != _fingerprint(docs, _hash(text, key)):
            raise ValueError(f"the job in {out} has another corpus")
        if not store.get_file_info(f"{folder}/_tokens/_SUCCESS").is_file:
            manifest = None
    if not manifest:
        if store.get_file_info(folder).type.name == "Directory":
            known = any(store.get_file_info(f"{folder}/{x}").type.name != "NotFound" for x in ("manifest.json", "_tokens"))
            if not known and store.get_file_info(_listing(folder)):
                raise FileExistsError(f"{out} holds something else than a job of this kind")
            store.delete_dir_contents(folder)
        store.create_dir(folder, recursive=True)
        with small_batches(spark):
            tokenised(docs, text, key, vocabulary).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(f"{out}/_tokens")
    staged = spark.read.schema(schema).parquet(f"{out}/_tokens")
    if not manifest:
        manifest = {"settings": settings, "corpus": _fingerprint(staged, F.col("print"))}
        _replace_file(store, folder, "manifest.json", json.dumps(manifest).encode())
    blocks = staged.groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # one row for each task
    base, total = {}, 0
    for r in blocks:
        base[r["block"]] = total
        total += r["n"]
    n = -(-total // length)
    shards = -(-n // shard_slots)
    if not n:
        return spark.createDataFrame([], _INDEX)

    def cut(batches):
        import zstandard

        squeeze, held, size = zstandard.ZstdCompressor(level=3), {}, 0

        def flush():
            rows = [(s, squeeze.compress(b"".join(x[0] for x in v)), np.array([x[1:5] for x in v], dtype=np.int64).tobytes(), [x[5] for x in v]) for s, v in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], ["shard", "ids", "places", "doc_ids"])

        for b in batches:
            for block, start, doc_id, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                first = base[block] + start
                last = first + len(ids) // 2 - 1
                seqs = np.arange(first // length, last // length + 1)
                for q, slot in zip(seqs.tolist(), feistel(seqs, n, permutation_key).tolist(), strict=True):
                    a, z = max(first, q * length), min(last + 1, (q + 1) * length)
                    held.setdefault(slot // shard_slots, []).append((ids[2 * (a - first) : 2 * (z - first)], slot, q, a - q * length, z - a, doc_id))
                size += len(ids)
                if size >= _BUFFER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def check(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                table = _checked(out, shard, min(shard_slots, n - shard * shard_slots), 2 * length)
                if table is not None:
                    yield from table.to_batches()

    def write(table: pa.Table) -> pa.Table:
        import zstandard

        shard = table.column("shard")[0].as_py()
        low = shard * shard_slots
        slots = min(shard_slots, n - low)
        data = np.full((slots, length), END_OF_TEXT, dtype="<u2")
        count, seq, docs_of = np.zeros(slots, np.int64), np.zeros(slots, np.int64), [[] for _ in range(slots)]
        for ids, places, who in zip(*(table.column(c).to_pylist() for c in ("ids", "places", "doc_ids")), strict=True):
            ids = np.frombuffer(zstandard.decompress(ids), dtype="<u2")
            at = 0
            for (slot, q, pos, k), d in zip(np.frombuffer(places, np.int64).reshape(-1, 4).tolist(), who, strict=True):
                data[slot - low, pos : pos + k] = ids[at : at + k]
                at += k
                count[slot - low] += k
                seq[slot - low] = q
                docs_of[slot - low].append((pos, d))
        index = pa.table({
            "slot": pa.array(np.arange(low, low + slots)), "sequence": pa.array(seq), "shard": pa.array([_name(shard)] * slots),
            "offset": pa.array(np.arange(slots, dtype=np.int64) * length * 2), "n_ids": pa.array(count),
            "checksum": pa.array([zlib.crc32(memoryview(r).cast("B")) for r in data], pa.int64()),
            "doc_ids": pa.array([[d for _, d in sorted(x, key=lambda y: y[0])] for x in docs_of], pa.list_(pa.int64())),
        })
        own, folder = filesystem(out)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_table(index)
        _replace_file(own, folder, f"{_name(shard)}.index", sink.getvalue())
        _replace_file(own, folder, _name(shard), memoryview(data).cast("B"))
        return index

    pieces = staged.select("block", "start", "doc_id", "ids").mapInArrow(cut, "shard long, ids binary, places binary, doc_ids array<long>")
    done = None
    if resume:
        done = materialize(spark.range(shards).mapInArrow(check, _INDEX), "whole-shards")
        whole = done.select(F.expr(f"slot div {shard_slots}").alias("shard")).distinct()
        pieces = pieces.join(whole, "shard", "left_anti")
    with small_batches(spark):
        index = materialize(pieces.groupBy("shard").applyInArrow(write, _INDEX), "slots")
    if store.get_file_info(f"{folder}/_drafts").type.name == "Directory":
        store.delete_dir(f"{folder}/_drafts")
    if not keep_tokens:
        store.delete_dir(f"{folder}/_tokens")
    return index if done is None else index.unionByName(done)


def read_slots(out: str, first: int, last: int, length: int = 2048, shard_slots: int = 4096):
    """Sequences first..last-1 in training order, shard by shard; resumes at any slot."""
    store, folder = filesystem(out)
    at = first
    while at < last:
        shard = at // shard_slots
        stop = min(last, (shard + 1) * shard_slots)
        with store.open_input_file(f"{folder}/{_name(shard)}") as f:
            f.seek((at - shard * shard_slots) * length * 2)
            data = np.frombuffer(f.read((stop - at) * length * 2), dtype="<u2").reshape(-1, length)
        yield from data
        at = stop


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(read(spark, sf_dir, "documents"), new_folder(spark, "shards"))
