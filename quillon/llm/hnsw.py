"""Nearest neighbours by one hierarchical navigable small-world graph per shard.

Rows are dealt to shards by a hash of their id; each shard's graph is built in
one task and stored as flat neighbour arrays (int32, -1 filled), one per layer,
in the shared folder. A node's layer is geometric in a hash of its id. Nodes are
inserted from the highest layer down, some at a time (a fraction of those in the
graph): each searches the graph as it stands, with a beam of ``BUILD`` from the entry through the
layers, adds its fellows of the batch, and links to what the diversity rule leaves (a candidate closer to a chosen
neighbour than to the node is passed over; free places then go to the nearest passed over). Neighbours link back,
and lists that run over are thinned by the same rule. Nodes that no walk from the entry
reaches get links from the nearest reachable ones, in places kept for that. A search descends with a narrow beam and
keeps a beam of ``ef`` on the lowest layer, many queries at a time.

Equal vectors of a shard are one node with its ids in order. Shard results are
merged by exact double-precision distance of the vectors as they were given, ties to the smaller id.

Vectors that are null, zero, of another length than the most frequent one, or hold null or
non-finite components take no part, neither as queries nor as candidates. Null
ids take no part. Repeated rows of an id are candidates each; as queries, each distinct
vector of an id has its own ranks. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import BIN, DBL, INT, LONG, cleared, save, schema
from .words import mix

M0, M, REPAIR, BUILD, NARROW, EF, DESCENT, BATCH = 24, 12, 4, 80, 12, 128, 1 / 12, 256


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i, p] and b[i, q]."""
    return np.maximum((a * a).sum(2)[:, :, None] + (b * b).sum(2)[:, None, :] - 2 * np.matmul(a, b.transpose(0, 2, 1)), 0)


def _diverse(x: np.ndarray, base: np.ndarray, cand: np.ndarray, width: int) -> np.ndarray:
    """Of candidates for each base node (-1: none, may repeat), the ``width`` links that the diversity rule gives, nearest first, then the nearest of the others."""
    cand = np.where(cand == base[:, None], -1, cand)
    order = np.argsort(cand, axis=1, kind="stable")
    cand = np.take_along_axis(cand, order, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    vec = x[np.maximum(cand, 0)]
    own = _sq(x[base][:, None, :], vec)[:, 0]
    own[cand < 0] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    cand, own, vec = (np.take_along_axis(y, order.reshape(order.shape + (1,) * (y.ndim - 2)), 1) for y in (cand, own, vec))
    between = _sq(vec, vec)
    near = np.full(cand.shape, np.inf, dtype=np.float32)  # distance to the nearest chosen one
    chosen = np.zeros(cand.shape, dtype=bool)
    for j in range(cand.shape[1]):
        take = (own[:, j] < near[:, j]) & np.isfinite(own[:, j]) & (chosen.sum(1) < width)
        chosen[take, j] = True
        near[take] = np.minimum(near[take], between[take, j])
    rank = np.argsort(np.where(np.isfinite(own), ~chosen, 2), axis=1, kind="stable")[:, :width]
    out = np.where(np.isfinite(np.take_along_axis(own, rank, 1)), np.take_along_axis(cand, rank, 1), -1)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1).astype(np.int32)


def _beam(layer: np.ndarray, x: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, width: int = 8) -> np.ndarray:
    """The ``ef`` nodes nearest to each query that a walk from its ``start`` nodes (-1: none) finds, nearest first, -1 filled."""
    n, room = len(q), max(ef, start.shape[1])
    seen = np.zeros((n, len(layer)), dtype=bool)
    beam = np.full((n, room), -1, dtype=np.int64)
    dist = np.full((n, room), np.inf, dtype=np.float32)
    done = np.ones((n, room), dtype=bool)
    k = start.shape[1]
    d = _sq(q[:, None, :], x[np.maximum(start, 0)])[:, 0]
    beam[:, :k], dist[:, :k], done[:, :k] = start, np.where(start < 0, np.inf, d), start < 0
    r, c = np.nonzero(start >= 0)
    seen[r, start[r, c]] = True
    live = np.arange(n)
    while len(live):
        key = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(key, min(width, room - 1), axis=1)[:, :width] if width < room else np.argsort(key, axis=1)
        good = np.isfinite(np.take_along_axis(key, pick, 1))
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        who = beam[live[:, None], pick]
        now = done[live]
        np.put_along_axis(now, pick, True, 1)
        nb = np.where(good[:, :, None], layer[np.maximum(who, 0)], -1).reshape(len(live), -1)
        nb.sort(axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        fresh = (nb >= 0) & ~seen[live[:, None], np.maximum(nb, 0)]
        r, c = np.nonzero(fresh)
        node = nb[r, c]
        seen[live[r], node] = True
        d = np.full(nb.shape, np.inf, dtype=np.float32)
        d[r, c] = ((x[node] - q[live[r]]) ** 2).sum(1)
        all_d = np.concatenate([dist[live], d], axis=1)
        all_b = np.concatenate([beam[live], np.where(fresh, nb, -1)], axis=1)
        all_u = np.concatenate([now, ~fresh], axis=1)
        keep = np.argpartition(all_d, room - 1, axis=1)[:, :room]
        dist[live], beam[live], done[live] = (np.take_along_axis(v, keep, 1) for v in (all_d, all_b, all_u))
    order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
    return np.where(np.isfinite(np.take_along_axis(dist, order, 1)), np.take_along_axis(beam, order, 1), -1)


def _link_back(graph: np.ndarray, x: np.ndarray, new: np.ndarray, links: np.ndarray, width: int) -> None:
    """Add each new node to its neighbours' lists; lists that run over are thinned."""
    dst = links.ravel().astype(np.int64)
    src = np.repeat(new, links.shape[1])
    src, dst = src[dst >= 0], dst[dst >= 0]
    d = ((x[src] - x[dst]) ** 2).sum(1)
    order = np.lexsort((d, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    ok = place < width  # of the new ones, the nearest
    src, dst, place = src[ok], dst[ok], place[ok]
    nodes, at = np.unique(dst, return_inverse=True)
    more = np.full((len(nodes), int(place.max()) + 1 if len(place) else 0), -1, dtype=np.int32)
    more[at, place] = src
    for a in range(0, len(nodes), 1024):
        who = nodes[a : a + 1024]
        graph[who, :width] = _diverse(x, who, np.concatenate([graph[who, :width], more[a : a + 1024]], axis=1), width)


def _reach(graph: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(graph), dtype=bool)
    at = np.zeros(min(1, len(graph)), dtype=np.int64)
    while len(at):
        seen[at] = True
        at = np.unique(graph[at])
        at = at[at >= 0]
        at = at[~seen[at]]
    return seen


def _repair(graph: np.ndarray, x: np.ndarray) -> None:
    """Links in the last REPAIR places until every node can be reached from node 0."""
    width = graph.shape[1] - REPAIR
    while True:
        seen = _reach(graph)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return
        for a in range(0, len(lost), BATCH):
            part = lost[a : a + BATCH]
            found = _beam(graph, x, x[part], np.zeros((len(part), 1), np.int64), 4 * BUILD)
            for u, near in zip(part.tolist(), found, strict=True):
                near = near[near >= 0]
                room = (graph[near, width:] < 0).any(1)
                v = int(near[np.argmax(room)]) if room.any() else int(np.flatnonzero(seen & (graph[:, width:] < 0).any(1))[0])
                graph[v, width + int(np.argmax(graph[v, width:] < 0))] = u


def build(ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard's graph: distinct vectors (as given, and as float32) by falling layer, their ids, the layers' arrays."""
    _, first, back = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, back))
    sizes = np.bincount(back, minlength=len(first))
    begins = np.cumsum(sizes) - sizes
    low = ids[order][begins].view(np.uint64)
    unit = (mix(low ^ np.uint64(0x5A5A)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    level = np.floor(np.log(np.maximum(unit, 1e-300)) / np.log(DESCENT)).astype(int)
    hashed = np.lexsort((mix(low ^ np.uint64(0xA5A5)), -level))
    wide, level = x[first][hashed], level[hashed]
    members = [ids[order[begins[k] : begins[k] + sizes[k]]] for k in hashed.tolist()]
    v = wide.astype(np.float32)
    v -= v.mean(0)  # squares lose less where the vectors are far from the origin
    rows = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]  # a layer's nodes come first
    rows = [n for k, n in enumerate(rows) if k == 0 or n > 1]
    layers = [np.full((n, M0 + REPAIR if k == 0 else M), -1, dtype=np.int32) for k, n in enumerate(rows)]
    at = 1
    while at < len(v):
        top = min(int(level[at]), len(layers) - 1)
        to = min(len(v), at + min(BATCH, max(1, at // 8)))
        to = min(to, next((n for n in sorted(rows) if n > at), to))  # nodes of one top layer
        new = np.arange(at, to)
        q, start = v[new], np.zeros((len(new), 1), np.int64)
        mates = np.where(new[:, None] == new[None, :], -1, np.broadcast_to(new, (len(new), len(new))))
        if len(new) > M0:
            d = _sq(q[None], q[None])[0]
            np.fill_diagonal(d, np.inf)
            mates = new[np.argpartition(d, M0, axis=1)[:, :M0]]
        for k in range(len(layers) - 1, -1, -1):
            live = layers[k][: min(at, rows[k])]
            start = _beam(live, v, q, start, BUILD if k <= top else NARROW)
            if k <= top:
                width = M0 if k == 0 else M
                links = _diverse(v, new, np.concatenate([start, mates], axis=1), width // 2 if k == 0 else width)
                layers[k][new, : links.shape[1]] = links
                _link_back(layers[k], v, new, links, width)
            start = start[:, :NARROW] if k > top else start
        at = to
    _repair(layers[0], v)
    return {"x": wide, "members": np.concatenate(members), "ends": np.cumsum([len(m) for m in members]), "layers": layers}


def search(graph: dict, q: np.ndarray, ef: int = EF) -> np.ndarray:
    """Nodes found for each query (len(q) by ef, nearest first, -1 filled)."""
    if "near" not in graph:
        v = graph["x"].astype(np.float32)
        graph["mean"] = v.mean(0)
        graph["near"] = v - graph["mean"]
    v, q = graph["near"], q.astype(np.float32) - graph["mean"]
    start = np.zeros((len(q), 1), np.int64)
    for layer in reversed(graph["layers"][1:]):
        start = _beam(layer, v, q, start, NARROW)
    return _beam(graph["layers"][0], v, q, start, max(1, min(ef, len(v))))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the vector as given: an array of float or of double) of the rows that take part."""
    double = vectors.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<tinyint>", "array<smallint>")
    v = F.col("embedding").cast("array<double>" if double else "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_list()) if len(col) else np.zeros((0, 0), np.float32)


def build_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Store a graph for each shard."""

    def run(key, pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        g = build(pdf.vec_id.to_numpy(np.int64), _matrix(pdf.v))
        sizes = np.array([len(a) for a in g["layers"]], np.int64)
        links = b"".join(a.tobytes() for a in g["layers"])
        return pd.DataFrame({"shard": [key[0]], "dim": [g["x"].shape[1]], "width": [g["x"].itemsize], "sizes": [sizes.tobytes()], "x": [g["x"].tobytes()], "members": [g["members"].astype(np.int64).tobytes()], "ends": [g["ends"].astype(np.int64).tobytes()], "links": [links]})

    kinds = schema(shard=INT, dim=INT, width=INT, sizes=BIN, x=BIN, members=BIN, ends=BIN, links=BIN)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(shards)).cast("int"))
    return save(dealt.groupBy("shard").applyInPandas(run, kinds), "graphs")


def _load(r) -> dict:
    x = np.frombuffer(r.x, np.float32 if r.width == 4 else np.float64).reshape(-1, r.dim)
    links, at, layers = np.frombuffer(r.links, np.int32), 0, []
    for k, n in enumerate(np.frombuffer(r.sizes, np.int64).tolist()):
        width = M0 + REPAIR if k == 0 else M
        layers.append(links[at : at + n * width].reshape(n, width))
        at += n * width
    return {"x": x, "members": np.frombuffer(r.members, np.int64), "ends": np.frombuffer(r.ends, np.int64), "layers": layers}


def _others(members: np.ndarray, me: int, k: int) -> np.ndarray:
    """The first k of a node's ids (in order) that are not ``me``."""
    a, b = np.searchsorted(members, me), np.searchsorted(members, me, "right")
    return np.concatenate([members[: min(a, k)], members[b : b + k - min(a, k)]])


def nearest(vectors: DataFrame, query: Column, k: int = 10, shard_rows: int = 12_000, ef: int = EF, block: int = 256, group_queries: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where ``query`` (over vec_id) holds, equal rows once.

    Each group of queries meets each shard's graph in one task, which loads it once; neither is ever
    broadcast, and per query and shard only k candidates move on. A group has as many bytes as a graph
    or more, so what is copied is in proportion to queries times shards, as the searches are.
    """
    with cleared(vectors.sparkSession):
        return save(_ranked(vectors, query, k, shard_rows, ef, block, group_queries), "nearest", keep=True)


def _ranked(vectors: DataFrame, query: Column, k: int, shard_rows: int, ef: int, block: int, group_queries: int) -> DataFrame:
    rows = save(usable(vectors), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    graphs = build_shards(rows, shards)
    asks = save(rows.where(query).distinct().withColumn("ask", F.monotonically_increasing_id()), "asks")
    groups = max(1, -(-asks.count() // group_queries))
    asks = asks.withColumn("group", F.pmod(F.xxhash64("ask", F.lit(5)), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = graphs.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(key, left, right):
        out = []
        if len(left) and len(right):
            g = _load(left.iloc[0])
            begins = np.concatenate([np.zeros(1, np.int64), g["ends"][:-1]])
            right = right.sort_values("vec_id", kind="stable")
            for a in range(0, len(right), block):
                part = right.iloc[a : a + block]
                q = _matrix(part.v)
                found = search(g, q, ef)
                for i, (me, ask) in enumerate(zip(part.vec_id.to_numpy(), part.ask.to_numpy(), strict=True)):
                    nodes = found[i][found[i] >= 0]
                    d = np.sqrt(((g["x"][nodes].astype(np.float64) - q[i].astype(np.float64)) ** 2).sum(1))
                    ids = [_others(g["members"][begins[j] : g["ends"][j]], me, k) for j in nodes]
                    who = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                    dd = np.repeat(d, [len(z) for z in ids])
                    order = np.lexsort((who, dd))[:k]
                    out.append(pd.DataFrame({"ask": ask, "query_id": me, "vec_id": who[order], "score": dd[order]}))
        return pd.concat(out) if out else pd.DataFrame({"ask": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    got = copies.groupBy("shard", "group").cogroup(asks.groupBy("shard", "group")).applyInPandas(run, schema(ask=LONG, query_id=LONG, vec_id=LONG, score=DBL))
    rank = F.row_number().over(W.partitionBy("ask").orderBy("score", "vec_id"))
    return got.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
