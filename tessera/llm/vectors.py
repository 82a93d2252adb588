"""Embedding near-dedup (9): iterative quantisation and multi-index Hamming tables.

A rotation that makes balanced binary codes is learned on a sample of at most ``sample`` vectors; every
vector is coded. Codes are cut into chunks, one table for each; vectors of one label that agree in a
chunk meet in that table's bucket, where the cosine of the original vectors, in double precision,
decides. A pair counts in the first table where it meets, so that numbers of links add up without any list
of pairs. Chunks get longer with the largest label (``bucket`` vectors a value are aimed at). Tables of signs of
random projections follow, as many as find a pair at the threshold with probability ``recall`` without the
learned ones, at any width and length of vector: each bit differs with a probability of angle / pi.
Identical vectors are one row until the end. A bucket of more than ``tile`` rows is compared tile by tile.

A vector that is null, empty, zero, or holds null or non-finite components, or has no label, links with
nothing. Vectors of different lengths link never. Rows that repeat an id are one vector if equal; else
the id is a member through each of its vectors. A vector with a null id takes no part and has a row of its own, without links
and component.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import components, cut, local_roots, parts_for, tiled


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (principal axes times the learned rotation) of unit vectors x."""
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    v = centred @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def rotations(valid: DataFrame, sample: int, seed: int = 7) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector; fitted on the ``sample`` rows with the smallest hashes, random where they are few."""
    rows = valid.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for n, vectors in by.items():
        x = np.array(vectors)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[n] = learn_rotation(x) if len(x) >= 2 * n else random_rotation(n, seed)
    return out


def random_rotation(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(n), np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits of unit vectors, one column a bit."""
    return (x - model[0]) @ model[1] >= 0


def chunk_edges(bits: int, width: int) -> np.ndarray:
    """Where the chunks begin, and the end: all bits are shared out evenly, ``width`` bits a chunk or somewhat more."""
    return np.linspace(0, bits, max(1, bits // width) + 1).astype(int)


def chunk_values(bits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Numbers of the code's chunks."""
    return np.stack([bits[:, a:b][:, :62] @ (1 << np.arange(min(b - a, 62))) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1).astype(np.int64)


def tables_for(threshold: float, width: int, recall: float) -> int:
    """Tables of ``width`` random bits in one of which vectors at the threshold agree with probability ``recall``."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
    return 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log1p(-agree))


@functools.lru_cache(maxsize=8)
def planes(n: int, count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng((seed, n)).standard_normal((n, count))


def _bucket_links(vectors, values, table, own, i, j, threshold):
    """(local left, local right) of links of one bucket's tile that no earlier table has."""
    norms = np.sqrt((vectors * vectors).sum(1))
    unit = vectors / norms[:, None]
    lefts, rights = [], []
    for at in range(0, len(vectors), 1024):
        sims = unit[at : at + 1024] @ unit.T
        a, b = np.nonzero(sims >= threshold - 1e-9)
        a += at
        keep = (a < b) if i == j else ((own[a] == i) & (own[b] == j))
        a, b = a[keep], b[keep]
        exact = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= threshold
        a, b = a[exact], b[exact]
        if table:
            diff = values[a, :table] ^ values[b, :table]
            new = ~(diff == 0).any(axis=1)
            a, b = a[new], b[new]
        lefts.append(a)
        rights.append(b)
    return np.concatenate(lefts), np.concatenate(rights)


def embedding_near_dedup(vectors: DataFrame, threshold: float = 0.93, sample: int = 5_000, bucket: int = 32, tile: int = 2048, recall: float = 0.999, width: int | None = None, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each id. width: bits of a chunk, by the largest label if not given.

    Other columns of the vectors are not looked at.
    """
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("key", F.when(F.col("fine"), F.sha2(F.concat_ws("/", F.col("label").cast("string"), F.transform("v", lambda x: F.hex(F.xxhash64(x)))), 256)))
    same = cut(v.where("fine").groupBy("key").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    model = rotations(same, sample)
    spark = vectors.sparkSession
    most = same.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    width = width or (min(16, max(8, math.ceil(math.log2(most / bucket)))) if most > bucket else 8)
    more = tables_for(threshold, width, recall)
    held = spark.sparkContext.broadcast(model)  # a matrix for each length of vector in the sample

    def edges_of(n: int) -> np.ndarray:
        learned = chunk_edges(n, width)
        return np.concatenate([learned, n + chunk_edges(more * width, width)[1:]])

    def coded(lists):
        """(places, length, bits, chunks) of the batch's vectors, by length."""
        sizes = np.diff(lists.offsets.to_numpy())
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            x = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n).astype(float)
            unit = x / np.ldexp(1.0, np.frexp(np.abs(x).max(1, keepdims=True))[1])  # a power of two: no rounding
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            bits = np.concatenate([codes(unit, held.value.get(n) or random_rotation(n)), unit @ planes(n, more * width) >= 0], axis=1)
            yield at, n, bits, chunk_values(bits, edges_of(n))

    def count(batches):
        for batch in batches:
            for at, n, _, values in coded(batch.column(1)):
                t = np.tile(np.arange(values.shape[1], dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, values.shape[1]))), pa.array(np.full(len(t), n, np.int32)), pa.array(t), pa.array(values.ravel())], names=["label", "dim", "tbl", "value"])

    def file(batches):
        for batch in batches:
            for at, n, bits, values in coded(batch.column(3)):
                tables = values.shape[1]
                row = np.repeat(np.arange(len(at)), tables)
                take = pa.array(at[row])
                packed = pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(np.full(len(row), n, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(values.ravel()), batch.column(3).take(take), packed], names=["id", "copies", "label", "dim", "tbl", "value", "v", "bits"])

    kind, element = dict(vectors.dtypes)[label], "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    key = ["label", "dim", "tbl", "value"]
    base = same.select("id", "copies", "label", F.col("v").cast(f"array<{element}>").alias("v"))
    many = base.select("label", "v").mapInArrow(count, f"label {kind}, dim int, tbl int, value long").groupBy(*key).count().where(F.col("count") > tile)
    filed = base.mapInArrow(file, f"id long, copies long, label {kind}, dim int, tbl int, value long, v array<{element}>, bits binary")
    filed = tiled(filed, key, "id", tile, many=cut(many))
    groups = parts_for(same.count() * (8 + more), 40_000)
    key = [*key, "tile_i", "tile_j"]

    def compare(rows: pa.Table) -> pa.Table:
        ids, weights, dims, tables, own = (rows[k].to_numpy() for k in ("id", "copies", "dim", "tbl", "tile_own"))
        ti, tj, mark = rows["tile_i"].to_numpy(), rows["tile_j"].to_numpy(), rows["mark"].to_numpy()
        order = np.lexsort((ids, tj, ti, mark))
        same_as_last = (mark[order][1:] == mark[order][:-1]) & (ti[order][1:] == ti[order][:-1]) & (tj[order][1:] == tj[order][:-1])
        out: list[tuple] = []
        place = np.empty(len(ids), np.int64)  # among the rows of its length
        by_length = {}
        for n in np.unique(dims).tolist():
            at = np.flatnonzero(dims == n)
            place[at], take, edges = np.arange(len(at)), pa.array(at), edges_of(n)
            x = rows["v"].combine_chunks().take(take).flatten().to_numpy().reshape(-1, n).astype(float)
            packed = np.frombuffer(b"".join(rows["bits"].take(take).to_pylist()), np.uint8).reshape(len(at), -1)
            values = [chunk_values(np.unpackbits(packed[k : k + 4096], axis=1, count=int(edges[-1])).astype(np.int64), edges) for k in range(0, len(at), 4096)]
            by_length[n] = x / np.ldexp(1.0, np.frexp(np.abs(x).max(1, keepdims=True))[1]), np.concatenate(values)
        for g in np.split(order, np.flatnonzero(~same_as_last) + 1):
            if len(g) < 2:
                continue
            g = g[np.r_[True, ids[g][1:] != ids[g][:-1]]]
            x, c = (m[place[g]] for m in by_length[dims[g[0]]])
            t = tables[g[0]]
            a, b = _bucket_links(x, c, t, own[g], ti[g[0]], tj[g[0]], threshold)
            root = local_roots(len(g), a, b)
            links = np.bincount(a, weights[g][b], len(g)) + np.bincount(b, weights[g][a], len(g))
            some = np.flatnonzero(links)
            out.append((ids[g][some], links[some].astype(np.int64), ids[g][root[some]]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(columns, names=["id", "links", "root"])

    filed = filed.withColumn("mark", F.xxhash64(*key)).withColumn("grp", F.pmod(F.col("mark"), F.lit(groups)))
    links = cut(filed.groupBy("grp").applyInArrow(compare, "id long, links long, root long"))
    roots = components(links, "id", "root")
    found = same.select("key", F.col("id").alias("node"), "copies").join(links.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    found = found.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    rows = v.select("id", "key").join(found, "key", "left")
    rows = rows.groupBy("id").agg(F.max(F.coalesce("links", F.lit(0))).alias("n_links"), F.min(F.coalesce("root", "id")).alias("component_id"))
    rows = rows.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    nameless = vectors.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
    return rows.union(nameless)
