"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one node.  The nodes of a label are cut by hash
into shards of about SHARD_ROWS; a task builds the graph of one shard and every
node of the same or an earlier shard searches it, so each pair of shards meets
once.  The beam of a shard is doubled until an audit against brute force (AUDIT
of its nodes) finds RECALL of their links and nearest neighbours; a search whose
beam ends full of links is repeated with a wider one.  Found pairs count when
their cosine in double precision reaches the threshold.  Links leave a task as
counts per node and as a spanning set of edges, never as all pairs.

Nulls: a vector that is null, empty or zero, or holds a null or non-finite
component, and one without label, links with nothing.  Vectors of different
lengths are not compared.  A null id has a null component and counts as another
vector of its equals.  Repeated rows are rows of their own.  An empty table
gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusq.llm.components import components
from corpusq.plans.scratch import shared_folder

SHARD_ROWS = 4096
DEGREE, BEAM, BUILD_BEAM = 16, 48, 48
FIRST, BATCH, EXPAND, WIDER = 256, 256, 4, 4
AUDIT, NEAREST, RECALL = 48, 5, 0.99
#: Shards per label that the counting table is broadcast for; with more labels, the join shuffles.
BROADCAST_LABELS = 100_000


class Layer:
    """A navigable graph over the first nodes of a matrix of unit vectors; -1 pads the neighbour lists."""

    def __init__(self, vectors: np.ndarray, degree: int):
        self.vectors, self.degree = vectors, degree
        self.near = np.full((len(vectors), 2 * degree), -1, dtype=np.int64)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of each query's beam, unordered; -1 and -inf pad."""
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(self.vectors) + 1), dtype=bool)
        seen[:, -1] = True
        ids = np.full((len(queries), max(beam, entry.shape[1])), -1, dtype=np.int64)
        cosine = np.full(ids.shape, -np.inf)
        ids[:, :entry.shape[1]] = entry
        cosine[:, :entry.shape[1]] = np.where(entry >= 0, np.einsum("bkd,bd->bk", self.vectors[entry], queries), -np.inf)
        seen[rows, entry] = True
        done = ids < 0
        alive, expand = np.arange(len(queries)), max(EXPAND, beam // 24)
        while len(alive):
            part = np.where(done[alive], -np.inf, cosine[alive])
            take = np.argpartition(-part, min(expand, part.shape[1] - 1), axis=1)[:, :expand]
            ready = np.take_along_axis(part, take, 1) > -np.inf
            going = ready.any(axis=1)
            alive, take, ready = alive[going], take[going], ready[going]
            if not len(alive):
                break
            at = alive[:, None]
            done[at, take] = True
            found = np.where(ready[:, :, None], self.near[ids[at, take]], -1).reshape(len(alive), -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[at, found]] = -1
            seen[at, found] = True
            width = max(int((found >= 0).sum(axis=1).max()), 1)
            found = -np.sort(-found, axis=1)[:, :width]
            near = np.where(found >= 0, np.einsum("bkd,bd->bk", self.vectors[found], queries[alive]), -np.inf)
            all_ids = np.concatenate([ids[alive], found], axis=1)
            all_cosine = np.concatenate([cosine[alive], near], axis=1)
            all_done = np.concatenate([done[alive], found < 0], axis=1)
            best = np.argpartition(-all_cosine, ids.shape[1] - 1, axis=1)[:, :ids.shape[1]]
            ids[alive] = np.take_along_axis(all_ids, best, 1)
            cosine[alive] = np.take_along_axis(all_cosine, best, 1)
            done[alive] = np.take_along_axis(all_done, best, 1)
        return ids, cosine

    def choose(self, centre: np.ndarray, ids: np.ndarray, cosine: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours per row: those nearer to the centre than to any chosen one, then the nearest of the rest."""
        order = np.argsort(-cosine, axis=1, kind="stable")[:, :max(4 * most, most)]
        ids, cosine = np.take_along_axis(ids, order, 1), np.take_along_axis(cosine, order, 1)
        valid = (ids >= 0) & (cosine > -np.inf)
        vectors = self.vectors[ids]
        between = np.einsum("bkd,bld->bkl", vectors, vectors)
        chosen = np.zeros(ids.shape, dtype=bool)
        for k in range(ids.shape[1]):
            rival = np.where(chosen, between[:, k, :], -np.inf).max(axis=1)
            chosen[:, k] = valid[:, k] & (rival < cosine[:, k]) & (chosen.sum(axis=1) < most)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(ids, best, 1), -1)

    def link(self, new: np.ndarray, ids: np.ndarray, cosine: np.ndarray):
        """Give the new nodes their neighbours and the neighbours their way back."""
        picked = self.choose(new, ids, cosine, self.degree)
        self.near[new, :picked.shape[1]] = picked
        source, target = np.repeat(new, picked.shape[1]), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        for low in range(0, len(target), 1 << 14):
            high = low + (1 << 14)
            self._back(source[low:high], target[low:high])

    def _back(self, source, target):
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        width = self.near.shape[1] + int(many.max())
        lists = np.full((len(nodes), width), -1, dtype=np.int64)
        lists[:, :self.near.shape[1]] = self.near[nodes]
        row = np.repeat(np.arange(len(nodes)), many)
        lists[row, self.near.shape[1] + np.arange(len(target)) - np.repeat(first, many)] = source
        lists.sort(axis=1)
        lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
        count = (lists >= 0).sum(axis=1)
        fits = count <= self.near.shape[1]
        packed = -np.sort(-lists, axis=1)
        self.near[nodes[fits]] = packed[fits][:, :self.near.shape[1]]
        over = np.flatnonzero(~fits)
        for low in range(0, len(over), 512):
            some = over[low:low + 512]
            held = packed[some][:, :int(count[some].max())]
            cosine = np.where(held >= 0, np.einsum("bkd,bd->bk", self.vectors[held], self.vectors[nodes[some]]), -np.inf)
            kept = self.choose(nodes[some], held, cosine, self.near.shape[1])
            self.near[nodes[some]] = -1
            self.near[nodes[some][:, None], np.arange(kept.shape[1])] = kept


class Graph:
    """Layers over nested prefixes of the nodes, the topmost small; every layer is entered from the one above."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE):
        self.vectors, self.layers = vectors, []
        sizes = [len(vectors)]
        while sizes[-1] > FIRST:
            sizes.append(max(sizes[-1] // degree, 1))
        for size in reversed(sizes):
            layer = Layer(vectors[:size], degree)
            start = min(size, FIRST)
            everyone = np.arange(start)
            cosine = vectors[:start] @ vectors[:start].T
            cosine[everyone, everyone] = -np.inf
            ids = np.broadcast_to(everyone, (start, start)).copy()
            ids[everyone, everyone] = -1
            if start > 1:
                layer.link(everyone, ids, cosine)
            self.layers.append(layer)
            for low in range(start, size, BATCH):
                new = np.arange(low, min(low + BATCH, size))
                ids, cosine = self._descend(vectors[new], BUILD_BEAM, low)
                own = vectors[new] @ vectors[new].T
                own[np.arange(len(new)), np.arange(len(new))] = -np.inf
                self.layers[-1].link(new, np.concatenate([ids, np.broadcast_to(new, own.shape)], axis=1),
                                     np.concatenate([cosine, own], axis=1))

    def _descend(self, queries: np.ndarray, beam: int, inserted: int | None = None):
        top = self.layers[0]
        width = min(4, len(top.vectors))
        entry = np.argpartition(-(queries @ top.vectors.T), width - 1, axis=1)[:, :width] if inserted is None or len(self.layers) > 1 else (
            np.argpartition(-(queries @ top.vectors[:FIRST].T), width - 1, axis=1)[:, :width])
        for layer in self.layers[1:-1]:
            ids, cosine = layer.search(queries, entry, 8)
            entry = np.take_along_axis(ids, np.argsort(-cosine, axis=1)[:, :4], 1)
        return self.layers[-1].search(queries, entry, min(beam, len(self.layers[-1].vectors)))

    def links(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, node) pairs found with cosine at or above the threshold."""
        out, n = [], len(self.vectors)
        todo = np.arange(len(queries))
        while len(todo):
            again = []
            step = max(1, min(BATCH, (64 << 20) // max(n, 1), (1 << 17) // max(beam, 1)))
            for low in range(0, len(todo), step):
                mine = todo[low:low + step]
                ids, cosine = self._descend(queries[mine], beam)
                hit = (cosine >= threshold) & (ids >= 0)
                full = hit.all(axis=1) & (beam < n)
                again.append(mine[full])
                row, place = np.nonzero(hit & ~full[:, None])
                out.append((mine[row], ids[row, place]))
            todo, beam = np.concatenate(again), min(WIDER * beam, n)
        if not out:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def audited_beam(self, threshold: float, beam: int = BEAM, queries: np.ndarray | None = None) -> int:
        """The first beam whose searches find RECALL of the links and nearest neighbours, as the mean over the audited vectors.

        Nodes are audited, or some of ``queries``.  Each counts once, however many links it has.
        """
        n, vectors = len(self.vectors), self.vectors if queries is None else queries
        audit = np.unique(np.linspace(0, len(vectors) - 1, min(AUDIT, len(vectors))).astype(np.int64))
        asked = vectors[audit]
        exact = asked @ self.vectors.T
        nearest = min(NEAREST, n)
        wanted = exact >= threshold
        np.put_along_axis(wanted, np.argpartition(-exact, nearest - 1, axis=1)[:, :nearest], True, 1)
        while beam < n:
            row, node = self.links(asked, threshold, beam)
            ids, _ = self._descend(asked, beam)
            got = np.zeros((len(audit), n + 1), dtype=bool)
            got[row, node] = True
            got[np.arange(len(audit))[:, None], ids] = True
            if ((wanted & got[:, :n]).sum(axis=1) / wanted.sum(axis=1)).mean() >= RECALL:
                return beam
            beam *= 2
        return n


class _Shard:
    """Counts and a spanning set of links of one shard against itself and the queries that come."""

    def __init__(self, ids: list, vectors: np.ndarray, copies: np.ndarray, threshold: float):
        self.ids, self.vectors, self.copies, self.threshold = np.array(ids, dtype=object), vectors, copies, threshold
        self.graph = Graph(vectors)
        self.beam = self.graph.audited_beam(threshold)
        row, node = self.graph.links(vectors, threshold, self.beam)
        met = np.zeros((len(ids), len(ids)), dtype=bool)
        met[row, node] = True
        met |= met.T
        np.fill_diagonal(met, False)
        self.count = met @ copies.astype(np.float64)
        self.root = np.arange(len(ids))
        a, b = np.nonzero(met)
        self._join(a, b)

    def _join(self, a, b):
        """Union the ends of every pair: roots sink to the smallest position of their component."""
        while True:
            low = np.minimum(self.root[a], self.root[b])
            before = self.root.copy()
            np.minimum.at(self.root, before[a], low)
            np.minimum.at(self.root, before[b], low)
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]
            if (self.root == before).all():
                return

    def query(self, ids: list, vectors: np.ndarray, copies: np.ndarray):
        """Rows (node, other, links) of queries of earlier shards, some of which are audited first."""
        self.beam = self.graph.audited_beam(self.threshold, self.beam, vectors)
        row, node = self.graph.links(vectors, self.threshold, self.beam)
        if not len(row):
            return []
        np.add.at(self.count, node, copies[row].astype(np.float64))
        total = np.bincount(row, self.copies[node], len(ids))
        order = np.lexsort((node, row))
        row, node = row[order], node[order]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        head = node[first][np.cumsum(first) - 1]
        self._join(head, node)
        return [(ids[r], self.ids[n], int(total[r])) for r, n in zip(row[first], node[first])]

    def rows(self):
        for i in range(len(self.ids)):
            if self.count[i]:
                yield self.ids[i], self.ids[self.root[i]], int(round(self.count[i]))


FOUND = "node binary, other binary, links bigint"


def _search(threshold: float):
    def run(batches):
        group = shard = None
        held: list = [[], [], []]

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()),
                                               pa.array(columns[2], pa.int64())], names=["node", "other", "links"])

        def unit(vectors):
            matrix = np.array(vectors, dtype=np.float64)
            return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))

        def build():
            return _Shard(held[0], unit(held[1]), np.array(held[2], dtype=np.float64), threshold) if held[0] else None

        for batch in batches:
            space, place, kind, node, vector, copies = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(node):
                end = at
                while end < len(node) and (space[end], place[end], kind[end]) == (space[at], place[at], kind[at]):
                    end += 1
                if (space[at], place[at]) != group:
                    shard = shard or build()
                    if shard is not None:
                        yield batch_of(list(shard.rows()))
                    group, shard, held = (space[at], place[at]), None, [[], [], []]
                if kind[at] == 0:
                    for store, values in zip(held, (node, vector, copies)):
                        store += values[at:end]
                else:
                    shard = shard or build()
                    if shard is not None:  # a shard that got no node has nothing to find
                        yield batch_of(shard.query(node[at:end], unit(vector[at:end]), np.array(copies[at:end], dtype=np.float64)))
                at = end
        shard = shard or build()
        if shard is not None:
            yield batch_of(list(shard.rows()))
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    sound = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
             & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("_node", F.when(
        F.coalesce(sound, F.lit(False)), F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.col("embedding").cast("string")).cast("binary")))))
    path = shared_folder(spark, "vector-nodes")
    (rows.filter("_node is not null").groupBy("_node")
     .agg(F.first(F.concat_ws("|", F.col("label").cast("string"), F.size("embedding").cast("string"))).alias("space"),
          F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
     .write.parquet(path))
    nodes = spark.read.parquet(path)
    shards = nodes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    groups = shards.agg(F.sum("shards"), F.count(F.lit(1))).first()
    if groups[1] <= BROADCAST_LABELS:
        shards = F.broadcast(shards)
    placed = (nodes.join(shards, "space").withColumn("shard", F.pmod(F.xxhash64("_node"), F.col("shards")).cast("int"))
              .withColumn("place", F.explode(F.sequence("shard", F.col("shards") - 1)))
              .select("space", "place", (F.col("place") != F.col("shard")).cast("int").alias("kind"), "_node", "embedding", "copies"))
    tasks = max(2 * (groups[0] or 0), spark.sparkContext.defaultParallelism)
    found = (placed.repartition(tasks, "space", "place").sortWithinPartitions("space", "place", "kind", "_node")
             .mapInArrow(_search(threshold), FOUND))
    path = shared_folder(spark, "vector-links")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    counts = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "other"), "node", "other").withColumnRenamed("id", "_node")
    classes = nodes.select("_node", "least", "copies").join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").join(counts, "_node", "left").select(
        "_node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "_node").join(named, "_node", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))
