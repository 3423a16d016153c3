"""Near-duplicate vectors: small-world graphs per shard, exact cosine, union of links."""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved, take, tune
from .components import components

COSINE = 0.98
#: Vectors in a shard (a graph), and queries in a block.
SHARD, BLOCK = 16_384, 4_096
LINKS, BUILD, BEAM = 12, 24, 32
#: Tasks that share a shard's blocks of queries.
GROUPS = 4
#: Queries of each block that are compared with the whole shard, and the share of their links that must be found.
AUDIT, RECALL = 32, 0.999
#: Slack for float32 products; links are decided in double precision.
CLOSE = 1e-4


def _wide(least: float) -> tuple[float, float]:
    """The cosine of a ball, and of twice its angle (less some slack)."""
    angle = math.acos(min(1.0, max(-1.0, least)))
    return math.cos(angle), math.cos(min(math.pi, 2 * angle)) - 2 * CLOSE


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, nearest by product. It can be pickled.

    A vector that meets a node within the angle of ``least`` becomes a member of that node's ball instead of a
    node of its own, so a large group of near copies takes a few nodes. All that lies within the angle of a query is
    in a ball whose node lies within twice the angle.
    """

    def __init__(self, x: np.ndarray, least: float = COSINE):
        self.x = x
        self.ball, self.wide = _wide(least)
        self.level = [int(min(12, -math.log(u) / math.log(LINKS))) for u in np.random.default_rng(12).uniform(1e-12, 1, len(x))]
        self.near: list[list[np.ndarray] | None] = [None] * len(x)
        self.node = np.arange(len(x))
        self.top = -1
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "x"}

    def _beam(self, q: np.ndarray, enter: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest that a best-first walk meets, best first."""
        seen = {i for _, i in enter}
        ahead = [(-s, i) for s, i in enter]
        heapq.heapify(ahead)
        best = list(enter)
        heapq.heapify(best)
        while ahead:
            s, i = heapq.heappop(ahead)
            if -s < best[0][0] and len(best) >= width:
                break
            fresh = [j for j in self.near[i][level].tolist() if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for j, t in zip(fresh, (self.x[fresh] @ q).tolist()):
                if len(best) < width:
                    heapq.heappush(best, (t, j))
                    heapq.heappush(ahead, (-t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                    heapq.heappush(ahead, (-t, j))
        return sorted(best, reverse=True)

    def _select(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Neighbours that lie nearer to the vector than to those chosen before; the nearest others fill up."""
        ids = [i for _, i in found]
        among = self.x[ids] @ self.x[ids].T
        closest = np.full(len(ids), -2.0, np.float32)
        chosen: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(chosen) >= most:
                break
            if closest[k] < s:
                chosen.append(k)
                np.maximum(closest, among[k], out=closest)
        taken = set(chosen)
        rest = [k for k in range(len(found)) if k not in taken][: max(most - len(chosen), 0)]
        return np.array([ids[k] for k in chosen + rest], np.int32)

    def _insert(self, i: int) -> None:
        q, level = self.x[i], self.level[i]
        if self.entry < 0:
            self.near[i] = [np.empty(0, np.int32) for _ in range(level + 1)]
            self.entry, self.top = i, level
            return
        enter = [(float(self.x[self.entry] @ q), self.entry)]
        for at in range(self.top, level, -1):
            enter = self._beam(q, enter, 1, at)
        met = {}
        for at in range(min(level, self.top), -1, -1):
            enter = met[at] = self._beam(q, enter, BUILD, at)
        if enter[0][0] >= self.ball:
            self.node[i] = enter[0][1]
            return
        self.near[i] = [np.empty(0, np.int32) for _ in range(level + 1)]
        for at, found in met.items():
            mine = self._select(found, LINKS)
            self.near[i][at] = mine
            most = 2 * LINKS if at == 0 else LINKS
            for j in mine.tolist():
                others = np.append(self.near[j][at], np.int32(i))
                if len(others) > most:
                    s = self.x[others] @ self.x[j]
                    by = np.argsort(-s)
                    others = self._select(list(zip(s[by].tolist(), others[by].tolist())), most)
                self.near[j][at] = others
        if level > self.top:
            self.entry, self.top = i, level

    def search(self, q: np.ndarray, width: int) -> list[int]:
        """The nodes that a beam finds within twice the angle; a beam full of such doubles."""
        if self.entry < 0:
            return []
        enter = [(float(self.x[self.entry] @ q), self.entry)]
        for at in range(self.top, 0, -1):
            enter = self._beam(q, enter, 1, at)
        while True:
            found = self._beam(q, enter, width, 0)
            if len(found) < width or found[-1][0] < self.wide:
                return [i for s, i in found if s >= self.wide]
            width *= 2


class Shard:
    """The vectors of a shard in double precision, the members of each ball side by side, and their graph."""

    def __init__(self, graph: Graph, units: np.ndarray, least: float = COSINE):
        graph.x = units.astype(np.float32)
        self.graph, self.least = graph, least
        self.order = np.argsort(graph.node, kind="stable")
        self.x = units[self.order]
        of = graph.node[self.order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, int)
        self.span = {int(of[b]): (int(b), int(e)) for b, e in zip(first, np.append(first[1:], len(of)))}

    def pairs(self, queries: np.ndarray, which: np.ndarray, width: int):
        """For balls that some of the queries reach: queries, members (places in ``order``), whether they are linked."""
        asked: dict[int, list[int]] = {}
        for k in which.tolist():
            for node in self.graph.search(queries[k].astype(np.float32), width):
                asked.setdefault(node, []).append(k)
        for node, by in asked.items():
            b, e = self.span[node]
            for at in range(0, len(by), 256):
                ks = np.array(by[at : at + 256])
                for low in range(b, e, 8192):
                    high = min(e, low + 8192)
                    linked = queries[ks] @ self.x[low:high].T >= self.least
                    if linked.any():
                        yield ks, np.arange(low, high), linked

    def width(self, queries: np.ndarray) -> int:
        """The beam doubles until an audit of queries spread over the block finds the share RECALL of the links that a
        comparison with the whole shard finds (or the beam is the whole shard). It begins with the shard's own beam."""
        audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
        return self._audited(queries, audit, getattr(self.graph, "width", BEAM))

    def own_width(self) -> int:
        """The beam that an audit by vectors near to some of the shard's own takes: such queries always have links, so a
        shard is audited even where few blocks have any."""
        x = self.x[np.unique(np.linspace(0, len(self.x) - 1, min(AUDIT, len(self.x))).astype(int))] if len(self.x) else self.x
        aside = np.random.default_rng(7).normal(size=x.shape)
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(aside, axis=1, keepdims=True)
        angle = 0.9 * math.acos(min(1.0, max(-1.0, self.least)))
        near = np.where(size > 1e-9, math.cos(angle) * x + math.sin(angle) * aside / np.maximum(size, 1e-9), x)
        return self._audited(near, np.arange(len(near)), BEAM)

    def _audited(self, queries: np.ndarray, audit: np.ndarray, width: int) -> int:
        total = sum(int((self.x @ queries[k] >= self.least).sum()) for k in audit)
        while width < len(self.x) and sum(int(linked.sum()) for _, _, linked in self.pairs(queries, audit, width)) < RECALL * total:
            width *= 2
        return width


def block_links(shard: Shard, nodes: np.ndarray, copies: np.ndarray, asked: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """For each query its number of links in the shard, and the pairs of a spanning forest of the block's links.

    Verified links are counted as they come and never kept: memory stays within the shard's and the block's vectors.
    """
    nodes, copies = nodes[shard.order], copies[shard.order].astype(np.int64)
    n_links = np.zeros(len(asked), np.int64)
    both, place = np.unique(np.concatenate([nodes, asked]), return_inverse=True)
    mine, theirs = place[len(nodes) :], place[: len(nodes)]
    group = np.arange(len(both))
    a, b = [], []
    for ks, members, linked in shard.pairs(queries, np.arange(len(asked)), shard.width(queries)):
        linked &= nodes[members][None, :] != asked[ks][:, None]
        n_links[ks] += linked @ copies[members]
        for row, k in enumerate(ks.tolist()):
            others = theirs[members[linked[row]]]
            new, first = np.unique(group[others], return_index=True)
            fresh = new != group[mine[k]]
            if fresh.any():  # a spanning forest of this block's links is enough for components
                a += [int(asked[k])] * int(fresh.sum())
                b += both[others[first[fresh]]].tolist()
                group[np.isin(group, new[fresh])] = group[mine[k]]
    return n_links, a, b


def _units(batches):
    """Vectors over their length, and 128 bits of them; null where a vector links with nothing."""
    for batch in batches:
        units, keys = [], []
        for i, label, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "v"))):
            unit = None
            if i is not None and label is not None and v and None not in v:
                x = np.array(v)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    x = x / top
                    unit = x / np.sqrt(x @ x) + 0.0  # no negative zeros
            units.append(unit)
            keys.append(None if unit is None else hashlib.md5(unit.tobytes()).digest())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(keys, pa.binary())], ["vec_id", "label", "unit", "key"])


def _blocks(size: str):
    """Vectors of one (label, block) as one row of packed arrays."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        flat = np.concatenate([np.asarray(v, np.float64) for v in table.column("unit").to_pylist()])
        return pa.table({
            "label": pa.array([table.column("label")[0].as_py()], pa.string()),
            "part": pa.array([table.column(size)[0].as_py()], pa.int64()),
            "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
            "copies": pa.array([table.column("copies").to_numpy().tobytes()], pa.binary()),
            "units": pa.array([flat.tobytes()], pa.binary()),
        })

    return run


def _unpacked(nodes: bytes, copies: bytes, units: bytes):
    n = np.frombuffer(nodes, np.int64)
    return n, np.frombuffer(copies, np.int64), np.frombuffer(units, np.float64).reshape(len(n), -1)


def _graphs(least: float):
    def run(batches):
        for batch in batches:
            made = []
            for n, c, u in zip(*(batch.column(x).to_pylist() for x in ("nodes", "copies", "units"))):
                _, _, units = _unpacked(n, c, u)
                graph = Graph(units.astype(np.float32), least)
                graph.width = Shard(graph, units, least).own_width()
                made.append(pickle.dumps(graph, protocol=5))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("label", "part", "nodes", "copies", "units")), pa.array(made, pa.binary())], ["label", "part", "nodes", "copies", "units", "graph"])

    return run


def _compare(least: float):
    """Rows by shard and group: first the shard with its graph, then blocks of queries, one in memory at a time."""

    def run(batches):
        shard = nodes = copies = None
        for batch in batches:
            for kind, n, c, u, g in zip(*(batch.column(x).to_pylist() for x in ("kind", "nodes", "copies", "units", "graph"))):
                if kind == 0:
                    nodes, copies, units = _unpacked(n, c, u)
                    shard = Shard(pickle.loads(g), units, least)
                    continue
                asked = np.frombuffer(n, np.int64)
                queries = np.frombuffer(u, np.float64).reshape(len(asked), -1)
                n_links, a, b = block_links(shard, nodes, copies, asked, queries)
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(n_links, pa.int64()), pa.array([None] * len(asked), pa.int64())], ["a", "n", "b"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array(b, pa.int64())], ["a", "n", "b"])

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", least: float = COSINE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label (all of them, when ``label`` is None) and one length are linked when their cosine, in double
    precision, is ``least`` or more. Equal vectors are one node with a count from the start. The nodes of a label are
    dealt into shards of about ``shard`` nodes by hash; one graph is built for each shard and met by blocks of queries
    of its label: every node queries every shard. A graph's beam is audited by vectors near to its own, then by some of
    each block's, and widened until both find their links. Found neighbours are verified; each block sends counts and
    a spanning forest of its links.

    Null, empty or zero vectors, vectors with null or non-finite components, vectors of a null label and of a null id
    link with nothing. Rows of one id and one vector are links of each other like any two rows.
    """
    spark = vectors.sparkSession
    tune(spark, 2048)
    names = {"vec_id": vec_id, "v": embedding} | ({"label": label} if label else {})
    rows = take(vectors, **names)
    if not label:
        rows = rows.withColumn("label", F.lit(""))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_units, "vec_id long, label string, unit array<double>, key binary")
    good = rows.where("key is not null")
    nodes = good.groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    nodes = saved(nodes.withColumn("of", F.concat_ws(":", "label", F.size("unit"))), "nodes")
    sizes = nodes.groupBy("of").agg(F.count("*").alias("total"))
    dealt = nodes.join(sizes, "of").select(F.col("of").alias("label"), "node", "copies", "unit", "total")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("total") / shard)).cast("long"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit("q")), F.ceil(F.col("total") / block)).cast("long"))
    kind = "label string, part long, nodes binary, copies binary, units binary"
    shards = saved(dealt.select("label", "part", "node", "copies", "unit").groupBy("label", "part").applyInArrow(_blocks("part"), kind), "shards")
    asks = saved(dealt.select("label", "block", "node", "copies", "unit").groupBy("label", "block").applyInArrow(_blocks("block"), kind), "queries")
    asks = asks.select("label", F.col("nodes").alias("q_nodes"), F.col("units").alias("q_units"), F.pmod("part", F.lit(GROUPS)).alias("g"))
    with batches_of(spark, 1):  # a row is now a whole shard or block
        graphs = saved(shards.repartition("label", "part").mapInArrow(_graphs(least), kind + ", graph binary"), "graphs")
        # a shard goes to GROUPS tasks at most, whatever its label's size; blocks of queries are what travels
        groups, parts, none = asks.select("label", "g").distinct(), graphs.select("label", "part"), F.lit(None).cast("binary")
        to = ["label", "part", "g", "kind"]
        held = graphs.join(groups, "label").withColumn("kind", F.lit(0)).select(*to, "nodes", "copies", "units", "graph")
        asked = asks.join(parts, "label").withColumn("kind", F.lit(1)).select(*to, F.col("q_nodes").alias("nodes"), none.alias("copies"), F.col("q_units").alias("units"), none.alias("graph"))
        met = held.union(asked).repartition(*to[:3]).sortWithinPartitions(*to)
        found = saved(met.mapInArrow(_compare(least), "a long, n long, b long"), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    reach = saved(components(found.where("b is not null").select("a", "b")), "classes")
    each = nodes.select("label", "key", "node", "copies")
    each = each.join(links, each["node"] == links["a"], "left").join(reach.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
    each = each.select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "label", "key").join(each, ["label", "key"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("vec_id")).alias("kept"))
