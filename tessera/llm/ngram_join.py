"""N-gram Jaccard join (2): chosen-path join of the documents' word shingles.

Words are runs of letters and digits, lower case; a document is the set of its shingles of ``words`` words
(a shorter one: of all its words). Documents with equal sets are one class until the end. Each run
sends every class down the branches of the shingles that it chooses: at a node, a shingle is
chosen if its hash with the node is under 1 / (similarity * size of the set), alike in all sets, so that two
similar sets are expected to share a branch. Small buckets are compared by brute force; the paths of larger
ones go on along branches that each node draws anew, up to ``depth`` shingles, and what is still large is compared
tile by tile, exactly. A member of a bucket with no other of a size that allows the similarity leaves it.
Runs are repeated until a pair at the threshold is missed with probability ``miss`` at most. Of two sets at the
threshold, whatever their sizes, a node's branches have one in common at least in the mean, so that a path of d
shingles is shared in a run with a probability of p(d) = 1 - exp(-p(d - 1)), p(0) = 1. Half of ``miss`` is for pairs
that share no first branch; classes in large buckets take more runs, by p(depth), for the other half.

A pair is counted in the first bucket that its two sets share. Null and empty texts, and texts without a
word, link with nothing and are classes of their own. Repeated rows belong to one class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BYTE_VALUES, SpanHash, chunked, components, cut, local_roots, mix, parts_for, row_key, tiled

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _IS_WORD[_c] = True
_IS_WORD[ord("\n")] = False


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted hashes of each text's shingles."""
    empty = np.empty(0, np.uint64)
    out: list[np.ndarray] = []
    for a, b in chunked(texts):
        raw = [(t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts[a:b]]
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        inside = _IS_WORD[buffer]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # words joined by nothing: spans run over a buffer that holds word bytes and a mark at each word's end
        keep = inside | (edge == -1)
        place = np.cumsum(keep) - 1
        packed = np.where(inside[keep], BYTE_VALUES[buffer[keep]], np.uint64(1))
        hashes = SpanHash(packed)
        first, last = place[start], place[stop] + 1
        ends = np.cumsum([len(r) for r in raw])
        bounds = np.searchsorted(start, np.r_[0, ends])
        if len(start) >= words:
            n = len(start) - words + 1
            spans = hashes(first[:n], last[words - 1 :])
        else:
            spans = empty
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                out.append(np.unique(spans[lo : hi - words + 1]))
            elif hi > lo:
                out.append(hashes(first[lo : lo + 1], last[hi - 1 : hi]))
            else:
                out.append(empty)
    return out


def _limit(sizes: np.ndarray, similarity: float) -> np.ndarray:
    limit = np.minimum(1.0 / (similarity * np.maximum(sizes, 1)), 1.0)
    return np.minimum(limit * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def branches(sets: list[np.ndarray], seeds: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, node) of the branches that the sets take at the runs' roots, by set."""
    sizes = np.array([len(s) for s in sets])
    owner, tokens = np.repeat(np.arange(len(sets)), sizes), np.concatenate([*sets, np.empty(0, np.uint64)])
    limit = _limit(sizes, similarity)[owner]
    found = []
    for seed in seeds:
        h = mix(tokens ^ np.uint64(seed))
        at = np.flatnonzero(h <= limit)
        found.append((owner[at], h[at].view(np.int64)))
    owner, node = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], node[order]


def tree(tokens: np.ndarray, seeds: list[int], similarity: float, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(parent, node) of a set's branches for each level; every node draws its own, alike in all sets."""
    limit, parents, levels = _limit(np.array([len(tokens)]), similarity)[0], np.array(seeds, np.uint64), []
    for _ in range(depth):
        step, found = max(1, (1 << 20) // max(1, len(tokens))), [(np.empty(0, np.uint64),) * 2]
        for at in range(0, len(parents), step):
            h = mix(tokens[None, :] ^ parents[at : at + step, None])
            who, which = np.nonzero(h <= limit)
            found.append((parents[at + who], h[who, which]))
        above, parents = (np.concatenate(x) for x in zip(*found, strict=True))
        levels.append((above.view(np.int64), parents.view(np.int64)))
    return levels


def run_seeds(runs: int) -> list[int]:
    return [int(x) for x in mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


def runs_for(miss: float, depth: int) -> int:
    share = 1.0
    for _ in range(depth):
        share = 1 - math.exp(-share)
    return math.ceil(math.log(miss) / math.log(1 - share) - 1e-9)


def _links(sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of sets that reach the similarity: brute force over shared tokens; with ``side``, pairs of two sides.

    Tokens that many of the sets hold are counted by products of matrices, the others by their few pairs.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, many, first = owner[order], many, np.cumsum(many) - many
    common = max(16, n // 32)
    both = np.zeros((n, n), np.float32)
    wide = np.flatnonzero(many > common)
    for at in range(0, len(wide), 2048):
        part = wide[at : at + 2048]
        m = np.zeros((n, len(part)), np.float32)
        rows = np.concatenate([owner[first[c] : first[c] + many[c]] for c in part.tolist()])
        m[rows, np.repeat(np.arange(len(part)), many[part])] = 1
        both += m @ m.T
    for k in range(2, common + 1):
        some = first[many == k]
        i, j = np.triu_indices(k, 1)
        for at in range(0, len(some), max(1, (1 << 20) // len(i))):
            members = owner[some[at : at + max(1, (1 << 20) // len(i)), None] + np.arange(k)]
            code, times = np.unique((members[:, i] * n + members[:, j]).ravel(), return_counts=True)
            both.ravel()[code] += times
    left, right = [], []
    for at in range(0, n, 512):
        sums = sizes[at : at + 512, None] + sizes
        shared = both[at : at + 512].astype(np.float64)
        near = shared >= similarity * (sums - shared) - 1e-6
        a, b = np.nonzero(near)
        a += at
        keep = a < b if side is None else (a < b) & (side[a] != side[b])
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)


def ngram_join(docs: DataFrame, similarity: float = 0.8, words: int = 5, miss: float = 1e-4, bucket: int = 2048, depth: int = 3, tokens: int = 1 << 21, key_bits: int = 21, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy_of (smallest id with the same shingles), n_copies, n_links (other documents that reach
    the similarity, copies included), class_id (smallest id reachable by links), kept (has it the class's id?), rkey (16
    bytes that name its id and text) and first (is it the class's one document that comes first, by id, nulls last, and rkey?).

    A row for each row of docs; null ids are members of classes, but a class takes its name from the others. Other columns
    of docs are not looked at. A bucket is large if it has more than ``bucket`` sets or than ``tokens`` shingles in all.
    """
    runs, more_runs = runs_for(miss / 2, 1), runs_for(miss / 2, depth)
    base = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rkey"), F.col(text_col).alias("text"))

    def sign(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            sids = [xxhash.xxh128_digest(t.tobytes()) if len(t) else None for t in sets]
            owner, node = branches(sets, run_seeds(runs), similarity)
            offsets = np.searchsorted(owner, np.arange(len(sets) + 1)).astype(np.int32)
            nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(node))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array([len(t) for t in sets], pa.int32()), nodes], names=["id", "rkey", "sid", "size", "nodes"])

    signed = cut(base.mapInArrow(sign, "id long, rkey binary, sid binary, size int, nodes array<long>"))
    classes = signed.where("sid is not null").groupBy("sid").agg(F.min("id").alias("first"), F.min(F.struct(F.col("id").isNull(), "id", "rkey")).alias("r"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("nodes").alias("nodes"))
    classes = cut(classes.select("sid", "first", F.col("r.rkey").alias("rkey"), "copies", "size", "nodes"))

    def sets_of(wanted: DataFrame, run, schema: str) -> DataFrame:
        """Run over (sid, text and the columns of ``wanted``), one row for each class wanted.

        ``wanted`` is read twice: pass a written table. The first ``key_bits`` bits of its row keys, 2 ** key_bits numbers at most whatever
        the corpus, are sent to the texts, so that of the texts not wanted only those are dealt out that share them: a share of
        n / 2 ** key_bits about, for n keys, which grows with n and doesn't jump. Rows that repeat a document come each; ``compare`` takes one.
        """
        bits = F.shiftrightunsigned(F.conv(F.hex(F.substring("rkey", 1, 4)), 16, 10).cast("long"), 32 - key_bits)
        texts = base.select("rkey", "text").withColumn("bits", bits).join(F.broadcast(wanted.select(bits.alias("bits")).distinct()), "bits", "left_semi")
        return texts.select("rkey", "text").join(wanted, "rkey").mapInArrow(run, schema)

    def alive(paths: DataFrame) -> DataFrame:
        """Members of a node that share it with a set of a size that the similarity allows, and how many it has."""
        by_size = Window.partitionBy("node").orderBy("size")
        below = F.lag("size").over(by_size) >= F.col("size") * F.lit(similarity - 1e-9)
        above = F.lead("size").over(by_size) * F.lit(similarity - 1e-9) <= F.col("size")
        found = paths.withColumn("near", F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))).where("near").drop("near")
        own = Window.partitionBy("node")
        large = (F.count("*").over(own) > bucket) | (F.sum("size").over(own) > tokens)
        return cut(found.withColumn("large", large))

    def grow(batches):
        """Of classes in large buckets: branches of the further runs, and those below the roots of all."""
        for batch in batches:
            sets, sids = shingle_sets(batch.column(1).to_pylist(), words), batch.column(2).to_pylist()
            seeds = run_seeds(more_runs)
            known = np.array(seeds[:runs], np.uint64).view(np.int64)
            cols: tuple[list, ...] = ([], [], [], [])
            for i, tokens in enumerate(sets):
                if not len(tokens) or xxhash.xxh128_digest(tokens.tobytes()) != sids[i]:
                    continue
                for level, (parent, node) in enumerate(tree(tokens, seeds, similarity, depth)):
                    if not level:
                        new = ~np.isin(parent, known)
                        parent, node = parent[new], node[new]
                    for c, v in zip(cols, (np.full(len(node), i), np.full(len(node), level, np.int32), parent, node), strict=True):
                        c.append(v)
            if cols[0]:
                row, level, parent, node = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(row)), batch.column(3).take(pa.array(row)), pa.array(level), pa.array(parent), pa.array(node)], names=["sid", "size", "level", "parent", "node"])

    paths = alive(classes.select("sid", "size", F.explode("nodes").alias("node")))
    leaf = (paths.where("not large") if depth > 1 else paths).select("sid", "size", "node")
    large = paths.where("large").select("sid", "size", "node")
    if depth > 1 and large.limit(1).count():
        hard = classes.join(large.select("sid").distinct(), "sid", "left_semi").select("rkey", "sid", "size")
        hard = cut(hard)
        grown = cut(sets_of(hard, grow, "sid binary, size int, level int, parent long, node long"))
        paths = alive(grown.where("level = 0").select("sid", "size", "node").distinct())
        leaf = leaf.union(paths.where("not large").select("sid", "size", "node"))
        large = large.union(paths.where("large").select("sid", "size", "node"))
        for level in range(1, depth):
            below = grown.where(F.col("level") == level).select("sid", F.col("parent").alias("node"), F.col("node").alias("next"))
            paths = alive(large.join(below, ["sid", "node"]).select("sid", "size", F.col("next").alias("node")).distinct())
            leaf = leaf.union((paths.where("not large") if level < depth - 1 else paths).select("sid", "size", "node"))
            large = paths.where("large").select("sid", "size", "node")
    # of nodes with the same members one is enough
    alike = leaf.distinct().groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.xxhash64("sid", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    leaf = leaf.distinct().join(alike.groupBy("n", "x", "s").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    places = tiled(cut(leaf), ["node"], "sid", bucket, "size", tokens)
    members = cut(places.groupBy("sid").agg(F.first("size").alias("size"), F.collect_list(F.struct("node", "tile_i", "tile_j", "tile_own")).alias("places")).join(classes.select("sid", "rkey", "copies"), "sid"))
    total = members.agg(F.sum(F.size("places")), F.sum(F.size("places") * F.col("size").cast("long"))).first()
    groups = max(parts_for(total[0] or 0, 1_500), parts_for(total[1] or 0, tokens // 4))

    def fetch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("text").to_pylist()
                sets = shingle_sets(texts, words)
                rows, cols = [], {k: [] for k in ("node", "tile_i", "tile_j", "tile_own")}
                for i, (tokens, sid, where) in enumerate(zip(sets, part.column("sid").to_pylist(), part.column("places").to_pylist(), strict=True)):
                    if len(tokens) and xxhash.xxh128_digest(tokens.tobytes()) == sid:
                        for w in where:
                            rows.append(i)
                            for k, v in cols.items():
                                v.append(w[k])
                all_nodes = [sorted({w["node"] for w in where}) for where in part.column("places").to_pylist()]
                take = lambda x: [x[i] for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array(cols["node"], pa.int64()), *(pa.array(cols[k], pa.int32()) for k in ("tile_i", "tile_j", "tile_own")), pa.array(take(part.column("sid").to_pylist()), pa.binary()), pa.array(take(part.column("copies").to_pylist()), pa.int64()), pa.array(take(all_nodes), pa.list_(pa.int64())), pa.array(take([s.tobytes() for s in sets]), pa.binary())], names=["node", "tile_i", "tile_j", "tile_own", "sid", "copies", "nodes", "tokens"])

    filed = sets_of(members.drop("size"), fetch, "node long, tile_i int, tile_j int, tile_own int, sid binary, copies long, nodes array<long>, tokens binary")
    filed = filed.withColumn("grp", F.pmod(F.xxhash64("node", "tile_i", "tile_j"), F.lit(groups)))

    def compare(rows: pa.Table) -> pa.Table:
        node, ti, tj, own, copies = (rows[k].to_numpy() for k in ("node", "tile_i", "tile_j", "tile_own", "copies"))
        order = np.lexsort((tj, ti, node))
        change = (np.diff(node[order]) != 0) | (np.diff(ti[order]) != 0) | (np.diff(tj[order]) != 0)
        out: dict[str, list] = {"sid": [], "links": [], "root": []}
        sid, nodes, tokens = rows["sid"], rows["nodes"], rows["tokens"]
        for g in np.split(order, np.flatnonzero(change) + 1):
            if len(g) < 2:
                continue
            seen: dict[bytes, int] = {}
            for x in g.tolist():  # repeated rows bring a class twice
                seen.setdefault(sid[x].as_py(), x)
            g = np.array(list(seen.values()))
            if len(g) < 2:
                continue
            a, b = _links([np.frombuffer(tokens[x].as_py(), np.uint64) for x in g.tolist()], similarity, own[g] if ti[g[0]] != tj[g[0]] else None)
            if len(a):
                all_nodes = [nodes[x].values.to_numpy() for x in g.tolist()]
                alike = np.array([len(n) == len(all_nodes[0]) and (n == all_nodes[0]).all() for n in all_nodes])
                here = node[g[0]]
                shared = {}
                first = [here == (all_nodes[x][0] if alike[x] and alike[y] else shared.setdefault((x, y), np.intersect1d(all_nodes[x], all_nodes[y], True)[0])) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                a, b = a[first], b[first]
            if not len(a):
                continue
            root = local_roots(len(g), a, b)
            w = copies[g]
            links = np.bincount(a, w[b], len(g)) + np.bincount(b, w[a], len(g))
            names = list(seen)
            for x in np.flatnonzero(links).tolist():
                out["sid"].append(names[x])
                out["links"].append(int(links[x]))
                out["root"].append(names[int(root[x])])
        return pa.table({"sid": pa.array(out["sid"], pa.binary()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.binary())})

    links = cut(filed.groupBy("grp").applyInArrow(compare, "sid binary, links long, root binary"))
    roots = components(links, "sid", "root")
    found = classes.select("sid", "first", "rkey", "copies").join(links.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    found = cut(found.select("sid", "first", "rkey", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root")))
    names = found.groupBy("root").agg(F.min("first").alias("class_id"), F.min(F.struct(F.col("first").isNull(), "first", "rkey")).alias("best"))
    found = found.drop("rkey").join(names.select("root", "class_id", F.col("best.rkey").alias("best")), "root").drop("root")
    rows = signed.select("id", "rkey", "sid").join(found, "sid", "left")
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce("first", "id").alias("copy_of"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce(F.col("id") == F.coalesce("class_id", "id"), F.lit(True)).alias("kept"),
        "rkey",
        F.coalesce(F.col("rkey") == F.col("best"), F.lit(True)).alias("first"),
    )
