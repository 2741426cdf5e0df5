"""N-gram Jaccard self-join by vertical partitioning.

The global order of shingles (their hashes) is cut into fragments.  Each
fragment sees its part of every document's set and counts partial overlaps
there; the parts are summed per document and, for candidate pairs, per pair.

1. *Fragments.*  Each task packs its distinct sets into one compact row for
   each fragment (sorted hash deltas, document numbers, a dictionary of
   classes).  Documents with equal sets are one class from here on, so exact
   copies cost nothing more.  A fragment drops shingles that only one class
   holds and returns the rest with their document frequency.  A shingle that
   many documents of a task hold (a line that a third of the corpus repeats)
   would flood its fragment: the task deals the occurrences by buckets of
   classes and sends the fragment their number and the buckets alone, to which
   the fragment answers with the frequency.  Texts are read once: the rows
   (document, size, class) travel with the fragments.
2. *Partial overlap with the rest of the corpus,* summed per class: a class of
   which fewer than 75 % of the shingles occur elsewhere has no partner
   (|x and y| >= 0.75 |x|) and drops out.  Texts that only share passages end here.
3. *Prefixes.*  In the order (document frequency, hash) two linked sets share
   one of their first |x| - ceil(0.75 |x|) + 1 shingles.  Posting lists of those
   give candidates, pruned by size and by what is left from that shingle on.
4. *Star first.*  Each class meets the centre of each of its lists, the class
   with the smallest share of shingles of its own.  Verified links give components; then only pairs across components are left
   to test, and all of them are (no caps): links inside a component cannot
   change the result.
5. *Partial counts* of the pairs: the sets of the remaining classes lie in
   segments of the global order; overlaps are counted by segment and summed.

``links`` gives the linked pairs of classes themselves, by steps 1 to 3 and 5.

Hashes keep 43 bits below the fragment's own; two different shingles of a pair
share one with a chance of about 2^-28 for sets of a thousand.

Defined cases: a null or word-less text has the empty set, links with nothing
and is its own component; equal rows and equal ids link like any other rows;
``component_id`` is the smallest non-null id of the component; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, join_components, materialize, read, shingle_set

_LOW = 43
_SEGMENTS = 4
#: Shingles and documents packed before a row for each fragment is emitted.
_PACK, _PACK_DOCS = 1_000_000, 60_000
#: Classes of one task that hold a shingle from which on its occurrences are dealt by class.
_HOT = 64
PERCENT = 75


def class_key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def mark_of(text: str) -> Column:
    """A hash of the text, which tells rows of one id apart."""
    return F.xxhash64(F.col(text)).alias("mark")


_PACKED = "frag long, h binary, who binary, classes binary, sizes binary"
_PARTS = "kind int, bucket long, classes binary, sizes binary, hs binary, dfs binary"
#: Kinds of rows behind the fragments: parts of sets, occurrences of hot shingles, their frequencies, documents.
_PART, _OCCURRENCE, _FREQUENCY, _DOCUMENT = range(4)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _pack(sets: list[np.ndarray], keys: list[int], bits: int, buckets: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], dtype=np.int32)
    h = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    frag = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
    low = (h << np.uint64(bits)) >> np.uint64(64 - _LOW)
    classes, rows = np.array(keys, dtype=np.int64), []
    start = np.flatnonzero(np.concatenate([[True], (frag[1:] != frag[:-1]) | (low[1:] != low[:-1])]))
    times = np.diff(np.append(start, len(h)))
    hot = np.repeat(times >= _HOT, times)
    if hot.any():
        full, owner = (low[hot] | (frag[hot].astype(np.uint64) << np.uint64(_LOW))).astype(np.int64), classes[who[hot]]
        size, bucket = sizes[who[hot]], (owner.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        # Markers for the fragments: how many occurrences of a shingle went to which bucket.
        asked = np.lexsort((bucket, full))
        f, b = full[asked], bucket[asked]
        cut = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1])]))
        count, f, b = np.diff(np.append(cut, len(f))), f[cut], b[cut]
        for part in np.unique(f >> _LOW):
            mine = (f >> _LOW) == part
            rows.append((int(part), (f[mine] & ((1 << _LOW) - 1)).tobytes(), b[mine].astype(np.int32).tobytes(), count[mine].astype(np.int64).tobytes(), b""))
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(cut)):
            part = order[cut[i] : cut[i + 1]]
            rows.append((-2 - 2 * int(i), full[part].tobytes(), b"", owner[part].tobytes(), size[part].tobytes()))
        h, who, frag, low = h[~hot], who[~hot], frag[~hot], low[~hot]
    cut = np.searchsorted(frag, np.arange((1 << bits) + 1))
    for f in range(1 << bits):
        a, b = cut[f], cut[f + 1]
        if a == b:
            continue
        delta = np.diff(low[a:b], prepend=np.uint64(0))
        packed = delta.astype(np.uint32) if delta.max() < 1 << 32 else delta
        used, local = np.unique(who[a:b], return_inverse=True)
        rows.append((f, packed.tobytes(), local.astype(np.uint16).tobytes(), classes[used].tobytes(), sizes[used].tobytes()))
    return _batch(rows, _PACKED)


def fragments(docs: DataFrame, text: str, key: str, width: int, bits: int, buckets: int) -> DataFrame:
    """Packed rows by fragment (0 and up); occurrences of hot shingles and documents under negative numbers, two for each bucket."""

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        sets, keys, n, seen = [], [], 0, set()
        for b in batches:
            sizes, classes = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                k = class_key(s) if len(s) else 0
                sizes.append(len(s))
                classes.append(k)
                if not len(s) or k in seen:
                    continue
                seen.add(k)
                sets.append(s)
                keys.append(k)
                n += len(s)
                if n >= _PACK or len(sets) >= _PACK_DOCS:
                    yield _pack(sets, keys, bits, buckets)
                    sets, keys, n, seen = [], [], 0, set()
            ids, marks = b.column(0), b.column(2).to_numpy().astype(np.int64)
            there = np.array(ids.is_valid()).astype(np.int64)
            who = np.stack([ids.fill_null(0).to_numpy().astype(np.int64), there, marks])
            yield _batch([(-1 - 2 * (at % buckets), who.tobytes(), b"", np.array(classes, np.int64).tobytes(), np.array(sizes, np.int64).tobytes())], _PACKED)
        if sets:
            yield _pack(sets, keys, bits, buckets)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), mark_of(text)).mapInArrow(run, _PACKED)


def _columns(table: pa.Table, names: str, types: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()] or [np.empty(0, t)]) for c, t in zip(names.split(), types, strict=True)]


def shared_parts(packed: DataFrame, buckets: int) -> DataFrame:
    """Per fragment and bucket of classes: the hashes that another class holds too, with their document frequencies, packed; frequencies of hot ones; other kinds of rows pass."""

    def run(table: pa.Table) -> pa.Table:
        f = table.column("frag")[0].as_py()
        if f < 0:
            kind, bucket = (_DOCUMENT, (-1 - f) // 2) if f % 2 else (_OCCURRENCE, (-2 - f) // 2)
            rows = [(kind, bucket, c, s, h, w) for h, w, c, s in zip(*(table.column(c).to_pylist() for c in ("h", "who", "classes", "sizes")), strict=True)]
            return pa.Table.from_batches([_batch(rows, _PARTS)])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("h", "who", "classes", "sizes")), strict=True))
        marks = [r for r in rows if not r[3]]
        asked = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(h, np.int64).astype(np.uint64) for h, *_ in marks)])
        asking = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(w, np.int32) for _, w, *_ in marks)])
        mark, inverse = np.unique(asked, return_inverse=True)
        times = np.bincount(inverse, np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c, np.int64) for _, _, c, _ in marks)]), len(mark)).astype(np.int64)
        hs, ks, ss = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for h, who, classes, sizes in rows:
            if not sizes:
                continue
            w = np.frombuffer(who, np.uint16)
            hs.append(np.cumsum(np.frombuffer(h, np.uint32 if len(h) == 4 * len(w) else np.uint64).astype(np.uint64)))
            ks.append(np.frombuffer(classes, np.int64)[w])
            ss.append(np.frombuffer(sizes, np.int32)[w])
        h, k, s = np.concatenate(hs), np.concatenate(ks), np.concatenate(ss)
        del rows, hs, ks, ss
        order = np.argsort(h, kind="stable")
        h, k, s = h[order], k[order], s[order]
        same = h[1:] == h[:-1]
        several = np.isin(h, mark)
        several[1:] |= same
        several[:-1] |= same
        h, k, s = h[several], k[several], s[several]
        order = np.lexsort((k, h))
        h, k, s = h[order], k[order], s[order]
        df = np.empty(0, dtype=np.int64)
        if len(h):  # the same class from two tasks
            once = np.ones(len(h), dtype=bool)
            once[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
            h, k, s = h[once], k[once], s[once]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(start, len(h)))
            if len(mark):  # occurrences elsewhere count too, and the frequency is the same for all
                at = np.minimum(np.searchsorted(mark, h[start]), len(mark) - 1)
                n_all = n + np.where(mark[at] == h[start], times[at], 0)
                there = np.minimum(np.searchsorted(h[start], mark), len(start) - 1)
                times = times + np.where(h[start][there] == mark, n[there], 0)
            else:
                n_all = n
            df = np.repeat(n_all, n)
            h, k, s, df = h[df > 1], k[df > 1], s[df > 1], df[df > 1]
        full = (h | np.uint64(f << _LOW)).astype(np.int64)
        df = df.astype(np.int32)
        bucket = (k.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for i in np.flatnonzero(np.diff(cut)):
            part = order[cut[i] : cut[i + 1]]
            rows.append((_PART, int(i), k[part].tobytes(), s[part].tobytes(), full[part].tobytes(), df[part].tobytes()))
        if len(mark):
            pair = np.unique(np.stack([asking.astype(np.int64), inverse.astype(np.int64)]), axis=1)
            full, times = (mark | np.uint64(f << _LOW)).astype(np.int64), times.astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], pair[0][1:] != pair[0][:-1]]))
            for a, z in zip(cut, np.append(cut[1:], pair.shape[1]), strict=True):
                which = pair[1][a:z]
                rows.append((_FREQUENCY, int(pair[0][a]), b"", b"", full[which].tobytes(), times[which].tobytes()))
        return pa.Table.from_batches([_batch(rows, _PARTS)])

    return packed.groupBy("frag").applyInArrow(run, _PARTS)


_SETS = "class long, size int, hs array<long>, dfs array<int>, ids array<long>, marks array<long>"


def shared_sets(parts: DataFrame) -> DataFrame:
    """The parts summed per class: (class, size, hs, dfs) of the classes of which enough occurs elsewhere, and the documents.

    A row of documents has ``ids`` and, in the same places, hashes of texts in ``marks``, classes in ``hs`` and sizes in ``dfs``.
    """

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        of = lambda which, names, types: _columns(table.filter(pa.array(kind == which)), names, types)
        k, s, h, df = of(_PART, "classes sizes hs dfs", (np.int64, np.int32, np.int64, np.int32))
        known, frequency = of(_FREQUENCY, "hs dfs", (np.int64, np.int32))
        if len(known):  # occurrences that were dealt by class: the fragments have counted them
            order = np.argsort(known)
            hot_k, hot_s, hot_h = of(_OCCURRENCE, "classes sizes hs", (np.int64, np.int32, np.int64))
            hot_df = frequency[order][np.searchsorted(known[order], hot_h)]
            k, s, h, df = (np.concatenate(x) for x in ((k, hot_k), (s, hot_s), (h, hot_h), (df, hot_df)))
        order = np.lexsort((h, k))
        k, s, h, df = k[order], s[order], h[order], df[order]
        once = np.ones(len(k), dtype=bool)
        once[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])  # a class that two tasks saw
        k, s, h, df = k[once], s[once], h[once], df[once]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, int)
        n = np.diff(np.append(start, len(k)))
        enough = 100 * n >= PERCENT * s[start]
        keep = np.repeat(enough, n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n[enough])]).astype(np.int32))
        start = start[enough]
        sets = pa.table({
            "class": pa.array(k[start]), "size": pa.array(s[start].astype(np.int32)), "hs": pa.ListArray.from_arrays(offsets, pa.array(h[keep])),
            "dfs": pa.ListArray.from_arrays(offsets, pa.array(df[keep].astype(np.int32))), "ids": pa.nulls(len(start), pa.list_(pa.int64())),
            "marks": pa.nulls(len(start), pa.list_(pa.int64())),
        })
        rows = [sets]
        docs = table.filter(pa.array(kind == _DOCUMENT))
        one = lambda a, t=pa.int64(): pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(t))
        for c, z, h in zip(*(docs.column(x).to_pylist() for x in ("classes", "sizes", "hs")), strict=True):
            size, (ids, there, marks) = np.frombuffer(z, np.int64), np.frombuffer(h, np.int64).reshape(3, -1)
            rows.append(pa.table({
                "class": pa.nulls(1, pa.int64()), "size": pa.nulls(1, pa.int32()), "hs": one(pa.array(np.frombuffer(c, np.int64), mask=size == 0)),
                "dfs": one(pa.array(size), pa.int32()), "ids": one(pa.array(ids, mask=there == 0)), "marks": one(pa.array(marks)),
            }))
        return pa.concat_tables(rows)

    return parts.groupBy("bucket").applyInArrow(run, _SETS)


def prefixes(kept: DataFrame) -> DataFrame:
    """(h, class, size, own, pos) for the prefix of each class in the order (document frequency, hash).

    ``own`` counts the shingles that no other class holds; they come first in
    the order, so ``pos``, the place of h in the whole order, is at least that.
    """

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for c, size, hs, dfs in zip(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(4)), strict=True):
                own = size - len(hs)
                n = size - (PERCENT * size + 99) // 100 + 1 - own
                first = np.lexsort((hs, dfs))[: max(n, 0)]
                for o, v in zip(out, (np.asarray(hs)[first], np.full(len(first), c), np.full(len(first), size), np.full(len(first), own), own + np.arange(len(first))), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(out, (np.int64, np.int64, np.int32, np.int32, np.int32), strict=True)], ["h", "class", "size", "own", "pos"])

    return kept.select("class", "size", "hs", "dfs").mapInArrow(run, "h long, class long, size int, own int, pos int")


def _possible(a: str, b: str) -> str:
    """Bounds that every linked pair meets at its first common prefix shingle: sizes, and an overlap of at most what is left from there on.

    At later common shingles less is left, so a pair passes somewhere if and only if it passes at the first.
    """
    return (
        f"100 * least({a}.size, {b}.size) >= {PERCENT} * greatest({a}.size, {b}.size) and "
        f"{100 + PERCENT}L * least({a}.size - {a}.pos, {b}.size - {b}.pos) >= {PERCENT}L * ({a}.size + {b}.size)"
    )


def candidate_sets(docs: DataFrame, text: str, width: int, bits: int | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2 in one reading of the texts: the classes that may have a partner, with what they share with the corpus, and (doc_id, mark, n_shingles, class) of every document."""
    if bits is None:
        bits = min(16, max(3, int(np.ceil(np.log2(max(1, docs.select(text).rdd.getNumPartitions()))))))
    buckets = 2 << bits
    both = materialize(shared_sets(shared_parts(fragments(docs, text, key, width, bits, buckets), buckets)), "sets")
    kept = both.where("ids is null").drop("ids", "marks")
    kept._placeloom_path = both._placeloom_path  # discarded with the first of the two
    rows = both.where("ids is not null").select(F.explode(F.arrays_zip("ids", "marks", "hs", "dfs")).alias("d"))
    return kept, rows.select(F.col("d.ids").alias("doc_id"), F.col("d.marks").alias("mark"), F.col("d.dfs").cast("long").alias("n_shingles"), F.col("d.hs").alias("class"))


def segments_of(kept: DataFrame) -> DataFrame:
    """(class, size, seg, hs): the sets cut into segments of the global order."""
    segment = F.filter(F.col("hs"), lambda x: F.pmod(F.shiftright(x, _LOW - 2), F.lit(_SEGMENTS)) == F.col("seg"))
    parts = kept.select("class", "size", "hs", F.explode(F.array(*[F.lit(i) for i in range(_SEGMENTS)])).alias("seg"))
    return parts.select("class", "size", "seg", segment.alias("hs"))


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, shared) of pairs whose partial overlaps, counted by segment of the global order and summed, reach the threshold."""
    left = segments.select(F.col("class").alias("a"), "seg", F.col("hs").alias("ha"), F.col("size").alias("size_a"))
    right = segments.select(F.col("class").alias("b"), "seg", F.col("hs").alias("hb"), F.col("size").alias("size_b"))
    part = pairs.join(left, "a").join(right, ["b", "seg"])
    part = part.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("ha", "hb")).alias("n"))
    total = part.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"), F.sum("n").alias("shared"))
    return total.where(f"100 * shared >= {PERCENT} * (size_a + size_b - shared)")


def links(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """The join itself: ``class_a, class_b, size_a, size_b, shared`` for every pair of different sets that link, each once.

    ``candidate_sets`` has the members of the classes; equal sets are one class
    and not paired.  Work and output grow with the number of links, which in a
    large group of near copies is quadratic: components alone come cheaper from
    ``class_components``, which needs no pair inside a component twice.
    """
    kept, _ = candidate_sets(docs, text, width)
    posting = prefixes(kept)
    pairs = posting.alias("x").join(posting.alias("y"), F.expr(f"x.h = y.h and x.class < y.class and {_possible('x', 'y')}"))
    pairs = pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    return overlaps(pairs, segments_of(kept)).withColumnsRenamed({"a": "class_a", "b": "class_b"})


def class_components(kept: DataFrame) -> DataFrame:
    """(class, component) for the classes of ``candidate_sets`` that are linked with another one."""
    posting = prefixes(kept)
    centre = F.min(F.struct((F.col("own") / F.col("size")).alias("far"), "class", "size", "pos")).alias("x")
    lists = posting.groupBy("h").agg(centre, F.count("*").alias("n")).where("n > 1").select("h", "x")
    posting = materialize(posting.join(lists, "h"), "postings")
    segments = segments_of(kept)
    star = posting.alias("y").where(f"y.class <> y.x.class and {_possible('y.x', 'y')}").select(F.col("y.x.class").alias("a"), F.col("y.class").alias("b"))
    star = materialize(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    found = materialize(overlaps(star, segments).select("a", "b"), "links")
    comp = materialize(components(found), "components")

    named = posting.select("h", "class", "size", "pos").join(comp, posting["class"] == comp["node"], "left")
    named = named.select("h", "class", "size", "pos", F.coalesce("component", "class").alias("c"))
    per = named.groupBy("h", "c").agg(F.count("*").alias("n"))
    main = per.groupBy("h").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count("*").alias("k")).where("k > 1").select("h", "main")
    open_lists = materialize(named.join(main, "h"), "open")
    x, y = open_lists.where("c <> main").alias("x"), open_lists.alias("y")
    rest = x.join(y, F.expr(f"x.h = y.h and x.c <> y.c and {_possible('x', 'y')}"))
    rest = rest.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    more = materialize(overlaps(rest.join(star, ["a", "b"], "left_anti"), segments).select("a", "b"), "links")
    if not more.isEmpty():
        comp_all = materialize(components(found.unionByName(more)), "components")
        discard(comp)
        comp = comp_all
    discard(star, posting, open_lists, found, more)
    return comp.select(F.col("node").alias("class"), "component")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id`` (links: Jaccard of at least 0.75)."""
    return groups(docs, text, key, width).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``jaccard_components`` with ``mark`` (the text's hash) and ``component``, a number that the members of a group share (null for the empty set)."""
    kept, sets = candidate_sets(docs, text, width, key=key)
    linked = class_components(kept)
    least = sets.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = materialize(least.join(linked, "class", "left"), "named")
    met = named.where("component is not null")
    whole = met.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    met = join_components(met.select("class", "component"), whole).select("class", "component", "component_id")
    alone = named.where("component is null").select("class", F.col("class").alias("component"), F.col("least").alias("component_id"))
    by_class = met.unionByName(alone).withColumnRenamed("class", "c")
    out = sets.join(by_class, sets["class"] == F.col("c"), "left")
    least_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = materialize(out.select("doc_id", "mark", "n_shingles", "component", least_id.alias("component_id")), "grouped")
    discard(kept, named)
    return out


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: Shingles as text, overlaps of all pairs that share one, and what the links reach.
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), i AS (
  SELECT rn, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0
), s AS (SELECT DISTINCT rn, array_to_string(ws[i:i + 4], ' ') AS g FROM i
), n AS (SELECT rn, count(*) AS n FROM s GROUP BY rn
), p AS (SELECT a.rn AS a, b.rn AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rn < b.rn GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.rn = a JOIN n y ON y.rn = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), link AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(n, m) AS (
  SELECT rn, rn FROM w UNION SELECT reach.n, link.b FROM reach JOIN link ON link.a = reach.m
), comp AS (SELECT n, min(doc_id) AS component_id FROM reach JOIN w ON w.rn = m GROUP BY n)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM w JOIN comp ON comp.n = w.rn LEFT JOIN n ON n.rn = w.rn
"""
