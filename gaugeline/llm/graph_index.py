"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

A shard's graph starts with random arcs; greedy beam searches from the medoid propose neighbours for every node, and
pruning keeps a proposal only when no kept neighbour is much nearer to it than the node itself (distances relaxed by a
factor), so arcs stay few and diverse. Arcs are added both ways and pruned again where a node has too many. Nodes that
no path from the start reaches get an arc from the nearest node that one does. Graphs and queries are written to the
shared folder; a task takes one shard and one block of queries, walks the graph with a beam, and answers are merged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import attempt_name, open_fs
from .shared import shared_dir, stage

#: Vectors of a shard, about, in small tables, and how many such shards there are before shards grow instead.
SHARD, SPREAD = 4096, 64
#: Bytes of a shard's vectors at most, about: beyond that the number of shards grows.
LARGEST = 64 << 20
#: Queries that visit a shard together.
BLOCK = 4096
DEGREE, BUILD_BEAM, QUERY_BEAM, RELAX = 24, 32, 96, 1.2
#: Beam of the first of two passes over the nodes, which only has to bring order into random arcs.
FIRST_BEAM = 8
#: Up to so many visits of a block to a shard are tasks of their own; of more, 16 share one.
VISITS = 4096
#: Nodes whose arcs a search follows in one step.
WIDE = 8


def beam_search(unit: np.ndarray, arcs: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of many queries at once: the nodes of each beam, nearest first, and their similarities."""
    q, n = len(queries), len(unit)
    nodes = np.full((q, beam), n, np.int64)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    nodes[:, 0], done[:, 0] = start, False
    near[:, 0] = queries @ unit[start]
    seen[:, start] = True
    seen[:, n] = True
    live = np.arange(q)
    while len(live):
        # The nearest nodes not followed yet; beams are sorted, so a stable sort of the marks finds them.
        first = np.argsort(done[live], axis=1, kind="stable")[:, :WIDE]
        waits = ~np.take_along_axis(done[live], first, 1)
        some = waits[:, 0]
        live, first, waits = live[some], first[some], waits[some]
        if not len(live):
            break
        done[live[:, None], first] = True
        at = np.where(waits, nodes[live[:, None], first], n)
        next_ = np.sort(arcs[at].reshape(len(live), -1), axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        # Only what is new is measured, packed to the left.
        width = max(1, int(fresh.sum(axis=1).max()))
        pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        next_, fresh = np.take_along_axis(next_, pick, 1), np.take_along_axis(fresh, pick, 1)
        score = np.matmul(unit[np.where(fresh, next_, 0)], queries[live][:, :, None])[:, :, 0]
        score[~fresh] = -np.inf
        all_near = np.concatenate([near[live], score], axis=1)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, next_, n)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[live] = np.take_along_axis(all_near, best, 1)
        nodes[live] = np.take_along_axis(all_nodes, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    return np.where(near > -np.inf, nodes, -1), near


def robust_prune(unit: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node the proposals kept as arcs; -1 in ``proposed`` is no proposal, len(unit) in the result no arc."""
    n = len(unit)
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    proposed[proposed == own[:, None]] = -1
    there = unit[np.maximum(proposed, 0)]
    away = 2 - 2 * np.einsum("bd,bcd->bc", unit[own], there)
    away[proposed < 0] = np.inf
    kept = np.full((len(own), degree), n, np.int64)
    rows = np.arange(len(own))
    for r in range(degree):
        best = np.argmin(away, axis=1)
        ok = np.isfinite(away[rows, best])
        if not ok.any():
            break
        kept[ok, r] = proposed[rows, best][ok]
        between = 2 - 2 * np.einsum("bd,bcd->bc", there[rows, best], there)
        away[relax * relax * between <= away] = np.inf
        away[rows, best] = np.inf
    return kept


def _reached(arcs: np.ndarray, start: int) -> np.ndarray:
    """Which nodes a path from the start leads to."""
    n = len(arcs) - 1
    reached = np.zeros(n + 1, bool)
    edge = np.array([start])
    while len(edge):
        reached[edge] = True
        edge = np.unique(arcs[edge])
        edge = edge[~reached[edge] & (edge < n)]
    return reached[:n]


def _connect(unit: np.ndarray, arcs: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Arcs with one more, in a column of its own where there is no room, to each node that no path leads to so far:
    from the nearest node that a search for it finds."""
    n = len(unit)
    while not (reached := _reached(arcs, start)).all():
        lost = np.flatnonzero(~reached)[:1024]
        nodes, _ = beam_search(unit, arcs, start, unit[lost], beam)
        for source, target in zip(nodes[:, 0].tolist(), lost.tolist()):
            free = np.flatnonzero(arcs[source] == n)
            if not len(free):
                arcs = np.concatenate([arcs, np.full((n + 1, 1), n)], axis=1)
                free = [arcs.shape[1] - 1]
            arcs[source, free[0]] = target
    return arcs


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Arcs of n + 1 rows, n where there is none, and the start node. Every node can be reached from it."""
    n, room = len(unit), degree + degree // 2
    mean = unit.mean(axis=0)
    start = int(np.argmax(unit @ mean))
    rng = np.random.default_rng(5)
    arcs = np.full((n + 1, room), n)
    arcs[:n, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for spread, width in ((1.0, min(beam, FIRST_BEAM)), (relax, beam)):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            own = order[at : at + 512]
            nodes, _ = beam_search(unit, arcs, start, unit[own], width)
            old = arcs[own]
            kept = robust_prune(unit, own, np.concatenate([nodes, np.where(old < n, old, -1)], axis=1), degree, spread)
            arcs[own, :degree], arcs[own, degree:] = kept, n
            target, source = kept.ravel(), np.repeat(own, degree)
            real = target < n
            target, source = target[real], source[real]
            there = (arcs[target] == source[:, None]).any(axis=1)
            target, source = target[~there], source[~there]
            if not len(target):
                continue
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            used = (arcs[heads] < n).sum(axis=1)
            fits = used + count <= room
            # Arcs go to the left, so that those of a node with room left follow them.
            arcs[heads] = np.sort(arcs[heads], axis=1)
            place = np.arange(len(target)) - np.repeat(first, count)
            light = np.repeat(fits, count)
            arcs[target[light], np.repeat(used, count)[light] + place[light]] = source[light]
            if fits.all():
                continue
            full = heads[~fits]
            back = np.full((len(full), int(count[~fits].max())), -1, np.int64)
            back[np.repeat(np.arange(len(full)), count[~fits]), place[~light]] = source[~light]
            old = arcs[full]
            kept = robust_prune(unit, full, np.concatenate([np.where(old < n, old, -1), back], axis=1), degree, spread)
            arcs[full, :degree], arcs[full, degree:] = kept, n
    return _connect(unit, arcs, start, beam), start


def _index_group(top: int, folder: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        ids = group["vec_id"].to_numpy()
        vectors = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        # Equal vectors, and those that only a power of two tells apart, have equal scores and are one node: its answers
        # are its smallest ids, and more than top + 1 of them never count.
        _, first, node = np.unique(vectors / np.abs(vectors).max(axis=1, keepdims=True), axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        by = np.argsort(node, kind="stable")
        place = np.arange(len(by)) - np.searchsorted(node[by], node[by])
        members = np.full((len(first), top + 1), -1, np.int64)
        few = place <= top
        members[node[by][few], place[few]] = ids[by][few]
        distinct = vectors[first]
        # Scaled first, so that squares of very large or very small values neither overflow nor vanish.
        unit = distinct / np.abs(distinct).max(axis=1, keepdims=True)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        arcs, start = build_graph(unit) if len(unit) > 1 else (np.full((2, 1), 1), 0)
        system, path = open_fs(folder)
        system.create_dir(path)
        name = attempt_name("graph", ".npz")
        held = io.BytesIO()
        np.savez(held, vectors=distinct, unit=unit, arcs=arcs.astype(np.int32), members=members, start=start)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(held.getbuffer())
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "graph": [name]})

    return run


def _write_queries(folder: str):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        system, path = open_fs(folder)
        system.create_dir(path)
        name = attempt_name("queries", ".npz")
        held = io.BytesIO()
        np.savez(held, ids=block["vec_id"].to_numpy(), vectors=np.stack(block["embedding"].to_numpy()).astype(np.float64))
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(held.getbuffer())
        return pd.DataFrame({"dim": [block["dim"].iloc[0]], "queries": [name]})

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of a and b in double precision; equal rows give equal results wherever they stand."""
    a = a / np.abs(a).max(axis=-1, keepdims=True)
    b = b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def _search(index: dict, ids: np.ndarray, wanted: np.ndarray, top: int, beam: int) -> pd.DataFrame:
    """The nearest members of one shard for each query of a block."""
    vectors, unit, arcs, members = index["vectors"], index["unit"], index["arcs"].astype(np.int64), index["members"]
    found = []
    for at in range(0, len(ids), 256):
        own, part = ids[at : at + 256], wanted[at : at + 256]
        q = part / np.abs(part).max(axis=1, keepdims=True)
        q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        nodes, _ = beam_search(unit, arcs, int(index["start"]), q, beam)
        # The whole beam, so that single precision decides nothing.
        rows, slots = np.nonzero(nodes >= 0)
        score = cosines(part[rows], vectors[nodes[rows, slots]])
        flat = pd.DataFrame({"query_id": np.repeat(own[rows], top + 1), "vec_id": members[nodes[rows, slots]].ravel(), "score": np.repeat(score, top + 1)})
        flat = flat[(flat["vec_id"] >= 0) & (flat["vec_id"] != flat["query_id"])]
        found.append(flat.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(top))
    return pd.concat(found)


def _search_batches(folder: str, top: int, beam: int):
    def load(name: str) -> dict:
        system, path = open_fs(folder)
        with system.open_input_file(f"{path}/{name}") as f:
            return dict(np.load(io.BytesIO(f.read())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, {}
        for batch in batches:
            for graph, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if graph != last:
                    last, index = graph, load(graph)
                block = load(queries)
                yield pa.RecordBatch.from_pandas(_search(index, block["ids"], block["vectors"], top, beam), preserve_index=False)

    return run


def nearest(vectors: DataFrame, every: int = 50, top: int = 5, shard: int = SHARD, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest vectors found for each row whose vec_id is divisible by ``every``.

    Nearness is the cosine in double precision on the original vectors, ties go to the smaller vec_id, the query's own
    row is no candidate, and vectors are compared with those of equal length only. Rows with null vec_id, and vectors
    that are null, empty, all zero or hold a null or non-finite component, take no part. Of rows that repeat a vec_id,
    the smallest vector counts. Extra columns are ignored; an empty table gives an empty table.

    Vectors are dealt to shards by a hash of vec_id, so a group of equal vectors is spread. Small tables have SPREAD
    shards of ``shard`` vectors at most, so that all cores build; then shards grow, and only beyond LARGEST bytes
    their number does. Every block of queries visits every shard: a task reads one graph and one block after another
    from the shared folder, where each is written once, and no vector is shuffled more than once.
    """
    component = "embedding"
    fine = F.col(component).isNotNull() & F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine &= F.exists(component, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(component).cast("array<double>").alias(component))
    rows = rows.filter(F.col("vec_id").isNotNull() & fine).groupBy("vec_id").agg(F.min(component).alias(component)).withColumn("dim", F.size(component))
    rows = stage(rows, "vectors")
    counts = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, min(-(-counts[0] // shard), SPREAD), -(-8 * counts[2] // LARGEST))
    blocks = max(1, -(-counts[1] // BLOCK))
    folder = f"{shared_dir(vectors.sparkSession)}/graphs"
    # Explicit numbers of partitions: Spark would merge what is short in bytes but long in work.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).repartition(4 * shards, "dim", "shard")
    graphs = stage(dealt.groupBy("dim", "shard").applyInPandas(_index_group(top, folder), "dim int, graph string"), "graphs")
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = stage(asked.groupBy("dim", "block").applyInPandas(_write_queries(folder), "dim int, queries string"), "queries")
    # One short row for each visit, dealt evenly; those of a graph stay together.
    visits = stage(graphs.join(asked, "dim").select("graph", "queries"), "visits")
    number = visits.count()
    visits = visits.repartitionByRange(max(1, min(number, VISITS), number // 16), "graph", "queries").sortWithinPartitions("graph")
    found = visits.mapInArrow(_search_batches(folder, top, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
