"""Near-duplicate vectors on a robust-pruned flat graph.

Distinct vectors go to the shards of their nearest centers, so shards overlap. In each shard a flat graph is built: a
vector's nearest and some random others are pruned robustly (a neighbour goes if a nearer kept one is much closer to
it). The neighbour lists that a vector has in its shards are united. Every vector is then searched for in its shards:
greedily from the medoid, then through all neighbours of whatever lies in range. Pairs are verified by their exact
cosine, and recall is audited against a scan.

A shard of more than BLOCK vectors is split by a hash into blocks with a graph each, and its blocks are searched pair by
pair, so no task holds more than two blocks and none of their pairs is missed for the split. Vectors of different lengths
have no cosine: each length has shards of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.llm.components import components
from clickweir.llm.mixing import stored

SIMILAR = 0.95
SHARD = 800  # vectors per center
CENTERS = 4096  # at most; they go to every task
SAMPLE = 20_000  # vectors that the centers are fitted on, the first by a hash
OVERLAP = 3  # shards of a vector, doubled while the audited recall is too low
OVERLAPS = 3  # searches at most; a recall that is still too low raises
RECALL = 0.9  # the least that the audit accepts
BLOCK = 2048
NEAREST, RANDOM, DEGREE, ALPHA = 40, 12, 20, 1.2
BEAM = 24
SLACK = 0.05  # the search goes through vectors that are out of range by so much
AUDIT = 1000  # vectors that recall is measured on


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, unit): unit vectors in double precision and a 64-bit name of each distinct one; both null for
    vectors that are null, empty or zero, or hold null or non-finite components."""
    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units = [], []
            for values in batch.column(1).to_pylist():
                unit = None
                if values and None not in values:
                    raw = np.array(values, np.float64)
                    if np.isfinite(raw).all() and raw.any():
                        raw = raw / np.abs(raw).max()
                        unit = (raw / np.sqrt(raw @ raw)).tobytes()
                units.append(unit)
                nodes.append(None if unit is None else int(np.uint64(xxhash.xxh3_64_intdigest(unit)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "node", "unit"])

    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .mapInArrow(computed, "vec_id long, node long, unit binary"))


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _by_length(units: list[bytes]) -> dict[int, list[int]]:
    """Places of the units of each length in bytes."""
    out: dict[int, list[int]] = {}
    for i, unit in enumerate(units):
        out.setdefault(len(unit), []).append(i)
    return out


def fit_centers(nodes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centers for the lengths in bytes of the vectors, by spherical k-means on the SAMPLE vectors with the lowest hashes.

    A length has a center for each SHARD vectors, as many as its share of the sample tells, at most CENTERS in all. Lengths
    for which that is one center or none have no entry: they are one shard.
    """
    drawn: dict[int, list[bytes]] = {}
    for r in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("unit").collect():
        drawn.setdefault(len(r["unit"]), []).append(r["unit"])
    total = sum(map(len, drawn.values()))
    out = {}
    for size, units in drawn.items():
        k = min(CENTERS * len(units) // total, count * len(units) // total // SHARD, len(units))
        if k > 1:
            out[size] = _spherical_means(_matrix(units), k)
    return out


def _spherical_means(sample: np.ndarray, k: int) -> np.ndarray:
    centers = sample[:: max(1, len(sample) // k)][:k].copy()
    for _ in range(8):
        own = np.concatenate([(sample[a:a + 2000] @ centers.T).argmax(1) for a in range(0, len(sample), 2000)])
        for c in range(len(centers)):
            mean = sample[own == c].sum(0)
            if np.any(mean):
                centers[c] = mean / np.sqrt(mean @ mean)
    return centers


def assigned(nodes: DataFrame, centers: dict[int, np.ndarray], overlap: int = OVERLAP) -> DataFrame:
    """(node, unit, n, size, shard, shards): a row for each of the `overlap` shards of a vector, with all its shards. A
    shard is told by the vectors' length in bytes, `size`, and its number."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)  # at most CENTERS rows

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                units = some.column(1).to_pylist()
                near: list[np.ndarray] = [np.zeros(1, np.int32)] * len(units)
                for size, rows in _by_length(units).items():
                    if size in shared.value:
                        scores = _matrix([units[i] for i in rows]) @ shared.value[size].T
                        for i, own in zip(rows, np.argsort(-scores, axis=1, kind="stable")[:, :overlap].astype(np.int32)):
                            near[i] = own
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(near, pa.list_(pa.int32()))], ["node", "unit", "n", "shards"])

    return (nodes.select("node", "unit", "n").mapInArrow(routed, "node long, unit binary, n long, shards array<int>")
            .withColumn("size", F.length("unit")).withColumn("shard", F.explode("shards")))


def _pruned(vectors: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbour lists of a flat graph: robust pruning over the nearest and some random others, links both ways."""
    n = len(vectors)
    if n == 1:
        return [np.zeros(0, np.int64)]
    pick = np.random.default_rng(seed)
    out: list[list[int]] = [[] for _ in range(n)]
    near = min(NEAREST, n - 1)
    for lo in range(0, n, 256):
        own = np.arange(lo, min(n, lo + 256))
        sims = vectors[own] @ vectors.T
        sims[np.arange(len(own)), own] = -np.inf
        close = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        cand = np.concatenate([close, pick.integers(0, n, (len(own), RANDOM))], axis=1)
        dist = 1 - np.take_along_axis(sims, cand, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        alive = np.isfinite(dist)
        among = 1 - np.einsum("icd,ied->ice", vectors[cand], vectors[cand], optimize=True)
        rows = np.arange(len(own))
        for _ in range(DEGREE):
            best = alive.argmax(1)
            going = alive[rows, best]
            if not going.any():
                break
            for r in rows[going]:
                out[own[r]].append(cand[r, best[r]])
            alive &= ~(going[:, None] & (ALPHA * among[rows, best] <= dist))
            alive[rows, best] = False
    both: list[set[int]] = [set(o) for o in out]
    for i, others in enumerate(out):
        for j in others:
            both[j].add(i)
    return [np.array(sorted(b), np.int64) for b in both]


class Graph:
    def __init__(self, vectors: np.ndarray, lists: list[np.ndarray]):
        self.vectors = vectors
        width = max(1, max(map(len, lists), default=1))
        self.next = np.full((len(lists), width), -1, np.int32)
        for i, own in enumerate(lists):
            self.next[i, :len(own)] = own
        mean = vectors.mean(0)
        self.medoid = int((vectors @ mean).argmax())

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs in range: beam search from the medoid, then expansion through everything near range."""
        q, rows = len(queries), np.arange(len(queries))
        seen = np.zeros((q, len(self.vectors) + 1), bool)
        seen[:, -1] = True  # the place of missing neighbours, -1
        beam = np.full((q, BEAM), -1, np.int32)
        sims = np.full((q, BEAM), -np.inf)
        open_ = np.zeros((q, BEAM), bool)
        beam[:, 0], sims[:, 0], open_[:, 0] = self.medoid, queries @ self.vectors[self.medoid], True
        seen[:, self.medoid] = True
        expanded = np.zeros_like(seen)
        hits: list[tuple[np.ndarray, np.ndarray]] = [(rows, beam[:, 0].copy())]
        scores = [sims[:, 0].copy()]
        while True:
            masked = np.where(open_, sims, -np.inf)
            best = masked.argmax(1)
            active = rows[open_[rows, best]]
            if not len(active):
                break
            at = beam[active, best[active]]
            open_[active, best[active]] = False
            expanded[active, at] = True
            fresh = self.next[at]
            fresh = np.where(seen[active[:, None], fresh], -1, fresh)
            seen[active[:, None], fresh] = True
            got = np.einsum("qd,qrd->qr", queries[active], self.vectors[fresh], optimize=True)
            got[fresh < 0] = -np.inf
            close = got >= SIMILAR - SLACK
            hits.append((np.broadcast_to(active[:, None], got.shape)[close], fresh[close]))
            scores.append(got[close])
            all_sims, all_beam = np.concatenate([sims[active], got], 1), np.concatenate([beam[active], fresh], 1)
            all_open = np.concatenate([open_[active], fresh >= 0], 1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            sims[active], beam[active] = np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_beam, top, 1)
            open_[active] = np.take_along_axis(all_open, top, 1)
        who, what, score = (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), np.concatenate(scores))
        close = score >= SIMILAR - SLACK
        found_q, found_v = [who[close]], [what[close]]
        front_q, front_v = found_q[0], found_v[0]
        while len(front_q):
            new = ~expanded[front_q, front_v]
            front_q, front_v = front_q[new], front_v[new]
            expanded[front_q, front_v] = True
            next_q, next_v = [], []
            for lo in range(0, len(front_q), 4096):
                a, b = front_q[lo:lo + 4096], self.next[front_v[lo:lo + 4096]]
                new = ~seen[a[:, None], b]
                pairs = np.stack([np.broadcast_to(a[:, None], b.shape)[new], b[new]])
                seen[pairs[0], pairs[1]] = True
                key = np.sort(pairs[0].astype(np.int64) * (len(self.vectors) + 1) + pairs[1])
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
                a, b = np.divmod(key, len(self.vectors) + 1)
                near = np.einsum("pd,pd->p", queries[a], self.vectors[b], optimize=True) >= SIMILAR - SLACK
                next_q.append(a[near])
                next_v.append(b[near])
            front_q = np.concatenate(next_q) if next_q else np.zeros(0, np.int64)
            front_v = np.concatenate(next_v) if next_v else np.zeros(0, np.int64)
            found_q.append(front_q)
            found_v.append(front_v)
        return np.concatenate(found_q), np.concatenate(found_v)


def _build(table: pa.Table) -> pa.Table:
    nodes = np.asarray(table["node"].combine_chunks())
    order = np.argsort(nodes)
    nodes, units = nodes[order], table["unit"].to_pylist()
    lists = _pruned(_matrix([units[i] for i in order]), int(table["shard"][0].as_py()))
    return pa.table({"node": pa.array(nodes), "lists": pa.array([nodes[own] for own in lists], pa.list_(pa.int64()))})


def _side(rows: list[dict]) -> dict:
    rows = sorted(rows, key=lambda r: r["node"])
    nodes = np.array([r["node"] for r in rows], np.int64)
    lists = []
    for r in rows:
        own = np.array(r["lists"], np.int64)
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        lists.append(at[nodes[at] == own])
    vectors = _matrix([r["unit"] for r in rows])
    width = max(len(r["shards"]) for r in rows)
    shards = np.array([sorted(r["shards"]) + [-1] * (width - len(r["shards"])) for r in rows], np.int64)
    return {"nodes": nodes, "vectors": vectors, "graph": Graph(vectors, lists), "shards": shards, "n": np.array([r["n"] for r in rows], np.int64)}


def _found(graph: Graph, queries: np.ndarray) -> np.ndarray:
    out = np.zeros((len(queries), len(graph.vectors)), bool)
    for lo in range(0, len(queries), 256):
        q, v = graph.search(queries[lo:lo + 256])
        out[lo + q, v] = True
    return out


def _joined(pairs: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
    """Links fewer than `nodes` that join what the pairs (rows of indexes) join."""
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u, v = [], []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            u.append(int(nodes[a]))
            v.append(int(nodes[b]))
    return u, v


def _search(table: pa.Table) -> pa.Table:
    """Two blocks of a shard (or one and itself): how many links each vector has, and links that join what they join.

    A pair that shares several shards counts in the lowest of them.
    """
    rows = table.to_pylist()
    shard, left, right = rows[0]["shard"], rows[0]["one"], rows[0]["two"]
    a = _side([r for r in rows if r["block"] == left])
    same = left == right
    empty = not same and not any(r["block"] == right for r in rows)
    if empty:
        return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    b = a if same else _side([r for r in rows if r["block"] == right])
    found = _found(a["graph"], b["vectors"]).T  # a by b
    found = found | (found.T if same else _found(b["graph"], a["vectors"]))
    i, j = np.nonzero(np.triu(found, 1) if same else found)
    exact = np.concatenate([np.einsum("pd,pd->p", a["vectors"][i[x:x + 8192]], b["vectors"][j[x:x + 8192]]) >= SIMILAR for x in range(0, len(i), 8192)] or [np.zeros(0, bool)])
    i, j = i[exact], j[exact]
    common = np.full(len(i), np.iinfo(np.int64).max)
    for column in range(a["shards"].shape[1]):
        own = a["shards"][i, column]
        shared = (own >= 0) & (b["shards"][j] == own[:, None]).any(1)
        common = np.where(shared, np.minimum(common, own), common)
    counted = common == shard
    i, j = i[counted], j[counted]
    nodes = a["nodes"] if same else np.concatenate([a["nodes"], b["nodes"]])
    at = j if same else j + len(a["nodes"])
    links = np.bincount(i, weights=b["n"][j], minlength=len(nodes)) + np.bincount(at, weights=a["n"][i], minlength=len(nodes))
    some = np.flatnonzero(links)
    u, v = _joined(np.column_stack([i, at]), nodes)
    return pa.table({"node": pa.array([*nodes[some].tolist(), *u], pa.int64()), "other": pa.array([*[None] * len(some), *v], pa.int64()),
                     "links": pa.array([*links[some].astype(np.int64).tolist(), *[None] * len(u)], pa.int64())})


def linked(spark: SparkSession, nodes: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Rows (node, links) of counts to be summed, and rows (node, other) of links, for the distinct vectors `nodes`
    (node, unit, n), each searched for in `overlap` shards."""
    count = nodes.count()
    if not count:
        return spark.createDataFrame([], "node long, other long, links long")
    members = assigned(nodes, fit_centers(nodes, count), overlap)
    sizes = members.groupBy("size", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = stored(spark, members.join(sizes, ["size", "shard"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")
    lists = members.groupBy("size", "shard", "block").applyInArrow(_build, "node long, lists array<bigint>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))  # `overlap` lists each
    pairs = (members.join(united, "node").withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("one", F.least("block", "_with")).withColumn("two", F.greatest("block", "_with")))
    return pairs.select("size", "shard", "one", "two", "block", "node", "unit", "n", "shards", "lists").groupBy("size", "shard", "one", "two").applyInArrow(_search, "node long, other long, links long")


def audited_recall(nodes: DataFrame, links: DataFrame) -> float | None:
    """Share of the true links of AUDIT vectors (those with the lowest hashes, against all rows in blocks) that `links`
    (node, links) has; null if they have none."""
    asked = nodes.select("node", "unit").orderBy(F.xxhash64("node"), "node").limit(AUDIT).collect()
    if not asked:
        return None
    names, units = [r["node"] for r in asked], [r["unit"] for r in asked]
    queries = nodes.sparkSession.sparkContext.broadcast({size: (at, _matrix([units[i] for i in at])) for size, at in _by_length(units).items()})

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                units, n = some.column(0).to_pylist(), np.asarray(some.column(1))
                for size, rows in _by_length(units).items():
                    if size in queries.value:
                        at, asked = queries.value[size]
                        total[at] += (asked @ _matrix([units[i] for i in rows]).T >= SIMILAR) @ n[rows]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(total)], ["node", "links"])

    true = nodes.select("unit", "n").mapInArrow(scanned, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    own = nodes.select("node", "n").join(true, "node").join(links, "node", "left")
    found = own.agg(F.sum(F.col("true") - F.col("n")).alias("true"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("true") - F.col("n"))).alias("found")).first()
    return found["found"] / found["true"] if found["true"] else None


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of `vectors` (vec_id, embedding).

    Linked: cosine of SIMILAR or more in double precision, whatever the norm of the vectors; vectors of different numbers
    of components have no cosine and do not link, and those that are null, empty or zero or hold null or non-finite
    components link with nothing. n_links counts the other rows linked directly, equal rows among them; component_id is
    the smallest vec_id that links reach (its own included; null ids only if there is no other), kept tells whether it is
    the row's own. A search whose audited recall is below RECALL is done again with twice the overlap, OVERLAPS searches at
    most; if the last one's is too low as well, the call raises.
    """
    rows = stored(spark, unit_vectors(vectors), "vectors")
    nodes = stored(spark, rows.where("node IS NOT NULL").groupBy("node").agg(F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("first_id")), "nodes")
    for overlap in (OVERLAP << k for k in range(OVERLAPS)):
        found = stored(spark, linked(spark, nodes, overlap), "links")
        counts = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
        recall = audited_recall(nodes, counts)
        if recall is None or recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} of the links of {AUDIT} vectors, searched for in {overlap} shards, is below {RECALL}")
    joined = components(spark, found.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    grouped = (nodes.select("node", "n", "first_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left"))
    lowest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = grouped.join(lowest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return (rows.select("vec_id", "node").join(classes, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
            .withColumn("audited_recall", F.lit(recall).cast("double")))
