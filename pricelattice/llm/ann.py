"""Approximate nearest neighbours: a robust-pruned directed graph in each shard.

Equal rows are counted first and indexed once. They are dealt into shards of about SHARD rows by a hash of vec_id and vector, apart for each
dimension, so neither a vec_id nor a vector with very many rows fills a shard. In a shard, equal vectors are one node, so they cannot
crowd a neighbourhood either. Graphs are built and searched in single precision, on vectors shifted and scaled to the shard's spread. Nodes join the graph in growing batches: greedy beam searches on the
graph so far propose neighbours, and relaxed pruning (a candidate goes if a kept neighbour is closer to it by the factor ALPHA than the
node is) keeps few and diverse edges; reverse edges are added and pruned alike. Every row is indexed. A query beam-searches each shard;
the beam is ranked by exact distance in double precision, copies of its nodes are written out, and shards merge by (distance, vec_id).

Vectors that are null, all zero or hold a null or non-finite component take no part; only vectors of equal length are compared. A null
vec_id takes no part. Repeated rows are candidates row by row; the query's own vec_id never is. Where a query's vec_id has several
vectors, the one of fewest dimensions, then the least by component, asks. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelattice.llm.store import written

SHARD, DEGREE, BEAM, ALPHA, TOP, QUERY_BLOCK, SPARE = 4096, 32, 64, 1.2, 10, 2048, 8
#: Distance, in spreads of a shard, beyond which a query is drawn in.
FAR = 1e15
#: Tasks among which shards are dealt, at most.
TASKS = 20_000


def valid(df: DataFrame) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return df.select("vec_id", e.alias("v"), F.size("embedding").alias("dim")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    arrays = [np.asarray(c.flatten(), np.float64) for c in col.chunks if len(c)]
    return np.concatenate(arrays).reshape(-1, dim) if arrays else np.zeros((0, dim))


def _middle(a: np.ndarray) -> float:
    return float(np.quantile(a, 0.5, method="lower"))


class Graph:
    def __init__(self, x: np.ndarray, near: np.ndarray | None = None, entry: int = 0):
        # Medians: a few far-off vectors do not take the precision from the others.
        self.power = -int(np.frexp(_middle(np.abs(x).max(1)))[1])
        small = self._small(x)
        self.shift = np.median(small, 0)
        self.spread = _middle(np.abs(small - self.shift).max(1)) or 1.0
        self.x, self.entry = self.local(x), entry
        self.sq = (self.x * self.x).sum(1)
        self.near = np.full((len(x), DEGREE), -1, np.int32) if near is None else near

    def _small(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.ldexp(v, self.power), -1e290, 1e290)

    def local(self, v: np.ndarray) -> np.ndarray:
        """Vectors in the coordinates of the search; those very far off are drawn in along their ray, where only the direction tells."""
        with np.errstate(over="ignore"):
            v = np.clip((self._small(v) - self.shift) / self.spread, -1e290, 1e290)
        far = np.abs(v).max(1, keepdims=True)
        return (v * (FAR / np.maximum(far, FAR))).astype(np.float32)

    def beam(self, q: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, squared distances less the query's own square) of the beams of many queries in lockstep, nearest first, -1 and inf where short."""
        n, rows = len(q), np.arange(len(q))[:, None]
        ids, dist = np.full((n, width), -1, np.int64), np.full((n, width), np.inf, np.float32)
        seen, done = np.zeros((n, len(self.x)), bool), np.zeros((n, width), bool)
        ids[:, 0], seen[:, self.entry] = self.entry, True
        dist[:, 0] = self.sq[self.entry] - 2 * q @ self.x[self.entry]
        live = np.arange(n)
        while len(live):
            open_ = ~done[live] & (ids[live] >= 0)
            go = open_.any(1)
            live, open_ = live[go], open_[go]
            if not len(live):
                break
            at = open_.argmax(1)
            done[live, at] = True
            new = self.near[ids[live, at]].astype(np.int64)
            r = rows[live]
            bad = (new < 0) | seen[r, new]
            seen[r, np.where(new < 0, self.entry, new)] = True
            d = self.sq[new] - 2 * np.einsum("qrd,qd->qr", self.x[new], q[live], optimize=True)
            d[bad] = np.inf
            all_d, all_i = np.concatenate([dist[live], d], 1), np.concatenate([ids[live], np.where(bad, -1, new)], 1)
            all_f = np.concatenate([done[live], np.zeros(d.shape, bool)], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :width]
            k = np.arange(len(live))[:, None]
            ids[live], dist[live], done[live] = all_i[k, order], all_d[k, order], all_f[k, order]
        return ids, dist

    def prune(self, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Kept neighbours (DEGREE each, -1 where fewer) of nodes from candidate lists (-1: none)."""
        c = np.where(cand < 0, 0, cand)
        v = self.x[c]
        d = self.sq[c] + self.sq[node][:, None] - 2 * np.einsum("qmd,qd->qm", v, self.x[node], optimize=True)
        d = np.maximum(d, 0)
        d[(cand < 0) | (cand == node[:, None])] = np.inf
        order = np.argsort(d, 1, kind="stable")
        k = np.arange(len(node))[:, None]
        c, d, v = c[k, order], d[k, order], v[k, order]
        twice = np.zeros(c.shape, bool)  # the same candidate again has the same distance: drop all but its first
        s = np.argsort(c, 1, kind="stable")
        cs = c[k, s]
        twice[k, s[:, 1:]] = (cs[:, 1:] == cs[:, :-1]) & np.isfinite(d[k, s[:, :-1]])
        d[twice] = np.inf
        sq = self.sq[c]
        mutual = sq[:, :, None] + sq[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        alive, out = np.isfinite(d), np.full((len(node), DEGREE), -1, np.int32)
        for slot in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            w = np.flatnonzero(some)
            first = alive[w].argmax(1)
            out[w, slot] = c[w, first]
            alive[w] &= ALPHA * ALPHA * mutual[w, first] > d[w]
            alive[w, first] = False
        return out

    def link_back(self, node: np.ndarray) -> None:
        """Reverse edges of nodes that have just got their neighbours; lists that overflow are pruned."""
        src = np.repeat(node, DEGREE)
        dst = self.near[node].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, start, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(to), 256):
            part = slice(lo, lo + 256)
            most = int(count[part].max())
            add = np.full((len(to[part]), most), -1, np.int64)
            for k, (s, m) in enumerate(zip(start[part], count[part], strict=True)):
                add[k, :m] = src[s : s + m]
            cand = np.concatenate([self.near[to[part]], add], 1)
            used = (cand >= 0).sum(1)
            full = used > DEGREE
            if full.any():
                self.near[to[part][full]] = self.prune(to[part][full], cand[full])
            for k in np.flatnonzero(~full).tolist():
                row = np.unique(cand[k][cand[k] >= 0])
                self.near[to[part][k], : len(row)] = row


def build(x: np.ndarray, seed: int = 9) -> Graph:
    rng = np.random.Generator(np.random.PCG64(seed))
    g = Graph(x)
    entry = g.entry = int(g.sq.argmin())
    order = rng.permutation(len(x))
    order = np.concatenate([[entry], order[order != entry]])
    lo, size = 1, 1
    while lo < len(order):
        node = order[lo : lo + size]
        found, _ = g.beam(g.x[node])
        g.near[node] = g.prune(node, np.concatenate([found, order[max(0, lo - 8) : lo][None].repeat(len(node), 0)], 1))
        g.link_back(node)
        lo, size = lo + size, min(256, max(1, lo // 4))
    g.near = np.concatenate([g.near, np.full((len(x), SPARE), -1, np.int32)], 1)
    _connect(g)
    return g


def _connect(g: Graph) -> None:
    """Pruning may leave far-off nodes without a way in. Each gets an edge from the nearest node that its own search reaches and that has
    room; so that search now finds it."""
    reached = np.zeros(len(g.x), bool)

    def walk(start: int) -> None:
        front = np.array([start])
        reached[start] = True
        while len(front):
            new = np.unique(g.near[front])
            front = new[(new >= 0) & ~reached[np.maximum(new, 0)]]
            reached[front] = True

    walk(g.entry)
    for u in np.flatnonzero(~reached).tolist():
        if not reached[u]:
            found = g.beam(g.x[[u]])[0][0]
            found = found[found >= 0]
            room = found[(g.near[found] < 0).any(1)]
            v = int(room[0]) if len(room) else int(np.flatnonzero(reached & (g.near < 0).any(1))[0])
            g.near[v, int((g.near[v] < 0).argmax())] = u
            walk(u)


def index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, nodes (float64), near (int32), entry, ids (int64), their node and how many rows they are. A written table, for any query."""
    v = valid(vectors)
    counts = {r[0]: r[1] for r in v.groupBy("dim").count().collect()}  # one row for each dimension
    if not counts:
        counts = {0: 0}
    shards = F.create_map(*[F.lit(x) for d, n in counts.items() for x in (d, max(1, -(-n // shard_rows)))])
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), shards[F.col("dim")].cast("bigint")).cast("int"))
    v = v.groupBy("dim", "shard", "vec_id", "v").agg(F.count("*").alias("copies"))
    tasks = min(TASKS, sum(max(1, -(-n // shard_rows)) for n in counts.values()))
    schema = "dim int, shard int, nodes binary, near binary, entry int, ids binary, node_of binary, copies binary"

    def make(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        ids = t.column("vec_id").to_numpy()
        x = matrix(t.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        ids, x, copies = ids[order], np.ascontiguousarray(x[order] + 0.0), t.column("copies").to_numpy()[order]
        _, first, cls = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * dim))).reshape(-1), return_index=True, return_inverse=True)
        g = build(x[first])
        cls = cls.reshape(-1)
        pack = lambda a, k: pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "nodes": pack(x[first], "<f8"), "near": pack(g.near, "<i4"), "entry": pa.array([g.entry], pa.int32()), "ids": pack(ids, "<i8"), "node_of": pack(cls, "<i4"), "copies": pack(copies, "<i8")})

    return written(v.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(make, schema), "graphs")


def search(vectors: DataFrame, is_query: Column, graphs: DataFrame, top: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found for each query row. Blocks of queries meet shards on (dim, shard, block)."""
    q = valid(vectors.filter(is_query)).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("least")).select("vec_id", "least.dim", "least.v")
    n = q.count()
    blocks = max(1, -(-n // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    per_dim = graphs.groupBy("dim").agg(F.max("shard").alias("last"))  # one row for each dimension
    q = q.join(F.broadcast(per_dim), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    g = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple[pa.Scalar, ...], shard: pa.Table, qs: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if shard.num_rows and qs.num_rows:
            dim = key[0].as_py()
            take = lambda c, k: np.frombuffer(shard.column(c)[0].as_py(), k)
            x = take("nodes", "<f8").reshape(-1, dim)
            graph = Graph(x, take("near", "<i4").reshape(-1, DEGREE + SPARE), shard.column("entry")[0].as_py())
            ids, node, copies = take("ids", "<i8"), take("node_of", "<i4"), np.minimum(take("copies", "<i8"), top)
            by_node = np.argsort(node, kind="stable")  # ids are in order, so each node's are too, and each stands there once
            cut = np.searchsorted(node[by_node], np.arange(len(x) + 1))
            qid, qv = qs.column("vec_id").to_numpy(), matrix(qs.column("v"), dim)
            for lo in range(0, len(qid), 256):
                found, _ = graph.beam(graph.local(qv[lo : lo + 256]))
                for k, row in enumerate(found):
                    own = row[row >= 0]
                    d = np.sqrt(((x[own] - qv[lo + k]) ** 2).sum(1))
                    members = [by_node[cut[i] : min(cut[i + 1], cut[i] + top + 1)] for i in own.tolist()]
                    at = np.concatenate(members)
                    s = np.repeat(d, [len(y) for y in members])
                    many = np.where(ids[at] == qid[lo + k], 0, copies[at])
                    m, s = np.repeat(ids[at], many), np.repeat(s, many)
                    best = np.lexsort((m, s))[:top]
                    out["query_id"] += [int(qid[lo + k])] * len(best)
                    out["vec_id"] += m[best].tolist()
                    out["score"] += s[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["dim", "shard", "block"]
    hits = g.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
