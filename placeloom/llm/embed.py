"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Vectors are normalised in double precision and quantised to int8 with one
scale each; the norm of what quantisation lost is that vector's error bound e.
A tile product of two blocks of codes estimates the cosine within
``e_x + (1 + e_x) * e_y``.  Pairs surely above the threshold are links, pairs
surely below are none, and only the pairs in between are computed again in
double precision.

Only codes, scales and bounds are dealt to the tiles, an eighth of the vectors;
a tile names the rows that are in doubt with some other one, and the full
vectors of these rows alone are sent to that tile in a second step.

Equal vectors (by a 64-bit hash) are one node with a multiplicity.  A tile returns link counts
and a spanning forest, folded after every strip of 512 rows, so a group of near
copies of any size costs a tile no more than one strip's pairs.  Tiles hold two
blocks of bounded size; every pair of blocks is one task's work, so the work
grows with the square of the number of different vectors.

Defined cases: a vector that is null, empty, zero, or holds a null or
non-finite component links with nothing, equal ones included, and is its own
component; vectors of different lengths never link; rows with equal ids and
equal vectors link; null ids take part, and a component's id is its smallest
non-null id (null if it has none); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, join_components, materialize, read

BLOCK = 4096
_STRIP = 512
_SLACK = 1e-9  # above any rounding in the bounds themselves


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), int8 codes, scales and error norms."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow or underflow in the squares
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) + _SLACK
    return unit, codes, scale, error


def tile_estimates(x, y, same: bool, threshold: float):
    """Strip by strip: index pairs (i, j) that may link and whether they surely do; for a block with itself each pair once.

    ``x`` and ``y`` are (codes, scales, errors).
    """
    (cx, sx, ex), (cy, sy, ey) = x, y
    fx, fy = cx.astype(np.float32), cy.astype(np.float32)
    if cx.shape[1] * 127 * 127 >= 1 << 24:  # sums beyond what a float holds exactly
        fx, fy = cx.astype(np.float64), cy.astype(np.float64)
    for at in range(0, len(fx), _STRIP):
        dot = fx[at : at + _STRIP] @ fy.T
        bound = ex[at : at + _STRIP, None] + (1 + ex[at : at + _STRIP, None]) * ey.max()
        need = (threshold - bound) / sx[at : at + _STRIP, None]
        i, j = np.nonzero(dot >= np.minimum(need / sy.max(), need / sy.min()).astype(np.float32) - 1)
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        est = dot[i, j].astype(np.float64) * sx[i + at] * sy[j]
        err = ex[i + at] + (1 + ex[i + at]) * ey[j]
        maybe = est + err >= threshold
        i, j, sure = i[maybe] + at, j[maybe], (est - err >= threshold)[maybe]
        yield i, j, sure


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the links, for each of n rows."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == old).all():
            return label


class Fold:
    """Link counts and components of the n rows of a tile, folded as pairs come in."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.links, self.root = copies, np.zeros(len(copies), np.int64), np.arange(len(copies))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.copies)
        self.links += (np.bincount(i, self.copies[j], n) + np.bincount(j, self.copies[i], n)).astype(np.int64)
        pair = np.unique(np.stack([self.root[i], self.root[j]]), axis=1) if len(i) else np.empty((2, 0), int)
        self.root = forest(n, pair[0], pair[1])[self.root]

    def table(self, node: np.ndarray) -> dict[str, np.ndarray]:
        got = self.links > 0
        return {"node": node[got], "links": self.links[got], "root": node[self.root[got]]}


_CODES = "node long, copies long, dim int, block int, codes binary, scale double, error double"
_FOUND = "p int, q int, dim int, node long, links long, root long"


def _quantised(placed: DataFrame) -> DataFrame:
    """Codes, scale and error of each node; the vectors stay behind."""

    def run(batches):
        for b in batches:
            t = pa.table(b)
            parts = [t] if len(set(t.column("dim").to_pylist())) <= 1 else [t.filter(pa.compute.equal(t.column("dim"), d)) for d in set(t.column("dim").to_pylist())]
            for part in parts:
                if not part.num_rows:
                    continue
                _, codes, scale, error = quantise(_matrix(part))
                columns = [part.column(c) for c in ("node", "copies", "dim", "block")] + [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(error)]
                yield from pa.table(columns, ["node", "copies", "dim", "block", "codes", "scale", "error"]).to_batches()

    return placed.select("node", "copies", "dim", "block", "v").mapInArrow(run, _CODES)


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _tiled(rows: DataFrame) -> DataFrame:
    """Each row once for every tile (p, q), p <= q, of its block."""
    pair = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.struct(F.least("block", k).cast("int").alias("p"), F.greatest("block", k).cast("int").alias("q")))
    return rows.withColumn("tile", F.explode(pair)).select("*", "tile.p", "tile.q").drop("tile", "of")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id, n_links, component_id, kept``."""
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.withColumn("node", F.when(good, F.xxhash64(F.size("v"), "v"))).withColumn("n", F.when(F.col("node").isNotNull(), F.size("v")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("n").alias("dim"))
    nodes = materialize(nodes, "vectors")
    dims = nodes.groupBy("dim").count().collect()  # as many rows as vector lengths
    blocks = {r["dim"]: max(1, -(-r["count"] // block)) for r in dims}
    if not blocks:
        links = nodes.select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root")).limit(0)
    else:
        count = F.create_map(*[F.lit(x) for d, n in blocks.items() for x in (d, n)])
        of = F.try_element_at(count, F.col("dim"))
        codes = materialize(_quantised(nodes.withColumn("block", F.pmod(F.xxhash64("node", F.lit("tile")), of).cast("int"))), "codes")
        tiles = [F.col("dim"), F.col("p"), F.col("q")]

        def sides(table: pa.Table):
            p, q, dim = (table.column(c)[0].as_py() for c in ("p", "q", "dim"))
            node, copies, at = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
            return p, q, dim, node, copies, np.flatnonzero(at == p), np.flatnonzero(at == q)

        def result(p: int, q: int, dim: int, fold: Fold, node: np.ndarray, doubt: np.ndarray) -> pa.Table:
            """Links of the tile, and rows without links for the nodes in doubt."""
            found = fold.table(node)
            every = {"node": np.concatenate([found["node"], node[doubt]]), "links": np.concatenate([found["links"], np.zeros(len(doubt), np.int64)]), "root": np.concatenate([found["root"], node[doubt]])}
            n = len(every["node"])
            return pa.table({"p": np.full(n, p, np.int32), "q": np.full(n, q, np.int32), "dim": np.full(n, dim, np.int32), **every})

        def estimate(table: pa.Table) -> pa.Table:
            p, q, dim, node, copies, a, b = sides(table)
            code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(len(node), -1)
            scale, error = (table.column(c).to_numpy() for c in ("scale", "error"))
            fold, doubt = Fold(copies), np.zeros(len(node), dtype=bool)
            if len(a) and len(b):
                side = lambda k: (code[k], scale[k], error[k])
                for i, j, sure in tile_estimates(side(a), side(b), p == q, threshold):
                    i, j = a[i], b[j]
                    fold.add(i[sure], j[sure])
                    doubt[i[~sure]] = doubt[j[~sure]] = True
            return result(p, q, dim, fold, node, np.flatnonzero(doubt))

        def recompute(table: pa.Table) -> pa.Table:
            p, q, dim, node, copies, a, b = sides(table)
            unit, code, scale, error = quantise(_matrix(table))
            fold = Fold(copies)
            if len(a) and len(b):
                side = lambda k: (code[k], scale[k], error[k])
                for i, j, sure in tile_estimates(side(a), side(b), p == q, threshold):
                    i, j = a[i[~sure]], b[j[~sure]]
                    exact = np.zeros(len(i), dtype=bool)
                    for k in range(0, len(i), 1 << 15):
                        exact[k : k + (1 << 15)] = np.einsum("ij,ij->i", unit[i[k : k + (1 << 15)]], unit[j[k : k + (1 << 15)]]) >= threshold
                    fold.add(i[exact], j[exact])
            return result(p, q, dim, fold, node, np.empty(0, int))

        first = materialize(_tiled(codes.withColumn("of", of)).groupBy(*tiles).applyInArrow(estimate, _FOUND), "tiles")
        doubt = first.where("links = 0").select("dim", "p", "q", "node")
        again = doubt.join(nodes.select("node", "copies", "v"), "node").join(codes.select("node", "block"), "node")
        second = again.select("dim", "p", "q", "node", "copies", "block", "v").groupBy(*tiles).applyInArrow(recompute, _FOUND)
        links = first.where("links > 0").unionByName(second).select("node", "links", "root")
    links = materialize(links, "links")
    comp = materialize(components(links.where("node <> root").distinct(), "node", "root"), "components")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "least", "copies").join(counted, "node", "left").join(comp, "node", "left")
    named = materialize(named.select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "named")
    linked = named.where("component is not null")
    whole = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    met = join_components(linked.select("node", "n_links", "component"), whole).select("node", "n_links", "component_id")
    alone = named.where("component is null").select("node", "n_links", F.col("least").alias("component_id"))
    known = materialize(met.unionByName(alone).withColumnRenamed("node", "c"), "named")
    discard(nodes, links, comp, named, *((codes, first) if blocks else ()))
    out = rows.select("vec_id", "node").join(known, F.col("node") == F.col("c"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("vec_id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: All pairs in double precision, and what they reach.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rn, vec_id, embedding, CASE WHEN embedding IS NULL THEN NULL ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings
), g AS (
  SELECT rn, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.rn AS a, b.rn AS b FROM g a JOIN g b ON a.rn <> b.rn AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(n, m) AS (
  SELECT rn, rn FROM v UNION SELECT reach.n, link.b FROM reach JOIN link ON link.a = reach.m
), comp AS (
  SELECT n, min(vec_id) AS component_id FROM reach JOIN v ON v.rn = m GROUP BY n
), n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN comp ON comp.n = v.rn LEFT JOIN n ON n.a = v.rn
"""
