"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Each shard of at most a few thousand vectors gets a graph: points are inserted in
batches, a greedy beam search over the graph so far proposes neighbours, and relaxed
pruning keeps those that no kept neighbour is much closer to. Queries walk the graph of
every shard by beam search, in blocks; the best of all shards are ranked by exact cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.llm.common import cut

SHARD_ROWS = 4096
QUERY_BLOCK = 4096
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 128
RELAX = 1.2
ENTRIES = 4
SLICES = 64


def beam_search(
    units: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int,
    width: int = 4,
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``beam`` nearest points reached, nearest first.

    ``graph[i]`` lists the neighbours of ``i``, padded with -1. All queries advance
    together, ``width`` unexpanded points of each at a time. Missing places hold id -1.
    """
    n, rows = len(units), np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True
    ids = np.full((len(queries), beam), -1)
    dist = np.full((len(queries), beam), np.inf, np.float32)
    done = np.ones((len(queries), beam), bool)
    fresh = np.broadcast_to(starts, (len(queries), len(starts)))
    while True:
        at = np.where(fresh < 0, n, fresh)
        new = ~seen[rows, at]
        seen[rows, at] = True
        d = 2 - 2 * np.matmul(units[np.where(new, at, 0)], queries[:, :, None])[:, :, 0]
        # a point offered twice in one step counts once
        order = np.argsort(at, axis=1, kind="stable")
        ranked = np.take_along_axis(at, order, 1)
        again = np.zeros_like(new)
        np.put_along_axis(
            again, order[:, 1:], (ranked[:, 1:] == ranked[:, :-1]), axis=1
        )
        new &= ~again
        ids_all = np.hstack([ids, np.where(new, at, -1)])
        dist_all = np.hstack([dist, np.where(new, d, np.inf).astype(np.float32)])
        done_all = np.hstack([done, ~new])
        keep = np.argsort(dist_all, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(a, keep, 1) for a in (ids_all, dist_all, done_all))
        if done.all():
            return ids, dist
        nth = np.cumsum(~done, axis=1)
        pick = ~done & (nth <= width)
        place = np.argsort(~pick, axis=1, kind="stable")[:, :width]
        chosen = np.where(
            np.take_along_axis(pick, place, 1), np.take_along_axis(ids, place, 1), -1
        )
        done |= pick
        near = np.where(chosen[:, :, None] >= 0, graph[np.maximum(chosen, 0)], -1)
        fresh = near.reshape(len(queries), -1)


def robust_prune(
    units: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, relax: float
) -> np.ndarray:
    """Neighbour lists for ``points`` out of ``cands`` (padded with -1), padded with -1.

    Takes the nearest candidate left, then drops every other candidate that is closer to
    it, ``relax`` times over, than to the point itself.
    """
    cands = np.sort(cands, axis=1)
    bad = (cands < 0) | (cands == points[:, None])
    bad[:, 1:] |= cands[:, 1:] == cands[:, :-1]
    vectors = units[np.maximum(cands, 0)]
    own = 2 - 2 * np.matmul(vectors, units[points][:, :, None])[:, :, 0]
    own = np.where(bad, np.inf, own)
    between = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = ~bad
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for slot in range(degree):
        best = np.where(alive, own, np.inf).argmin(1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, slot] = cands[rows, best][has]
        alive &= ~((relax**2 * between[rows, best] <= own) & has[:, None])
        alive[rows, best] = False
    return out


def build_graph(
    units: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX,
    passes: int = 2, batch: int = 256,
) -> tuple[np.ndarray, np.ndarray]:
    """The graph (padded with -1) and the entry points."""
    n = len(units)
    rng = np.random.default_rng(n)
    centre = int(np.argmax(units @ units.mean(0)))
    order = rng.permutation(n)
    order = np.concatenate([[centre], order[order != centre]])
    starts = order[: min(ENTRIES, n)].copy()
    graph = np.full((n, degree), -1)
    for turn in range(passes):
        slack = 1.0 if turn + 1 < passes else relax
        at = 0
        while at < n:
            points = order[at : at + min(batch, max(1, at) if turn == 0 else batch)]
            at += len(points)
            found, _ = beam_search(units, graph, starts, units[points], beam)
            cands = np.hstack([found, graph[points]])
            graph[points] = robust_prune(units, points, cands, degree, slack)
            # edges back; a full list is pruned together with the newcomers
            src = np.repeat(points, degree)
            dst = graph[points].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            heads, first, count = np.unique(dst, return_index=True, return_counts=True)
            extra = np.full((len(heads), count.max(initial=0)), -1)
            extra[np.repeat(np.arange(len(heads)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            lists = np.hstack([graph[heads], extra])
            new = np.full((len(heads), degree), -1)
            lists_sorted = np.sort(lists, axis=1)[:, ::-1]
            lists_sorted[:, 1:][lists_sorted[:, 1:] == lists_sorted[:, :-1]] = -1
            lists_sorted = np.sort(lists_sorted, axis=1)[:, ::-1]
            fits = (lists_sorted >= 0).sum(1) <= degree
            new[fits] = lists_sorted[fits][:, :degree]
            for part in np.array_split(np.flatnonzero(~fits), max(1, (~fits).sum() // batch)):
                if len(part):
                    new[part] = robust_prune(units, heads[part], lists[part], degree, slack)
            graph[heads] = new
    return graph.astype(np.int32), starts


def _unit(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _vectors(column: pd.Series, kind: str = "<f8") -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in column])


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("cid", ignore_index=True)
    graph, starts = build_graph(_unit(_vectors(shard["vec"])))
    entry = np.zeros(len(shard), bool)
    entry[starts] = True
    return shard.assign(near=[row.tobytes() for row in graph], entry=entry)


def _search(shard: pd.DataFrame, queries: pd.DataFrame, k: int, beam: int) -> pd.DataFrame:
    columns = ["qid", "cid", "score"]
    if not len(shard) or not len(queries):
        return pd.DataFrame({c: [] for c in columns}).astype({"qid": int, "cid": int, "score": float})
    shard = shard.sort_values("cid", ignore_index=True)
    raw, asked = _vectors(shard["vec"]), _vectors(queries["vec"])
    units, graph = _unit(raw), _vectors(shard["near"], "<i4").astype(np.int64)
    starts = np.flatnonzero(shard["entry"].to_numpy())
    norms = np.linalg.norm(raw, axis=1)
    cids, out = shard["cid"].to_numpy(), []
    for at in range(0, len(queries), 256):
        part = asked[at : at + 256]
        ids, _ = beam_search(units, graph, starts, _unit(part), max(beam, k))
        safe = np.maximum(ids, 0)
        score = np.einsum("qkd,qd->qk", raw[safe], part) / (
            norms[safe] * np.linalg.norm(part, axis=1)[:, None]
        )
        score = np.where(ids < 0, -np.inf, score)
        best = np.lexsort((cids[safe], -score), axis=1)[:, :k]
        out.append(
            pd.DataFrame(
                {
                    "qid": np.repeat(queries["qid"].to_numpy()[at : at + 256], best.shape[1]),
                    "cid": cids[np.take_along_axis(safe, best, 1)].ravel(),
                    "score": np.take_along_axis(score, best, 1).ravel(),
                }
            )
        )
    found = pd.concat(out)
    return found[np.isfinite(found["score"])]


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    beam: int = SEARCH_BEAM,
) -> DataFrame:
    """The ``k`` rows of ``df`` nearest to each row of ``queries`` by cosine.

    Both tables have an id and a vector; a query's own id is never its answer. Returns
    ``(query_id, rank, vec_id, score)``, nearest first, ties to the smaller id, all
    candidates if there are fewer than ``k``.

    Equal vectors are folded into one point that keeps its ``k + 1`` smallest ids (an
    answer can need no more), so any number of copies costs one point. Every row is
    indexed. Defined results: rows with a null id, or a vector that is null, empty, zero
    or has null or non-finite parts, take no part on either side; vectors are compared
    with those of the same length only; repeated rows of one id count once; empty tables
    give an empty result; other columns are ignored.
    """
    rows = _usable(df, id_col, vec_col)
    first = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(SLICES))).orderBy("id")
    last = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k + 1)
    points = cut(
        few.groupBy("v").agg(F.min("id").alias("cid"), F.collect_list("id").alias("members"))
    )
    count = points.count()
    shards = max(1, -(-count // shard_rows))
    asked = _usable(queries, id_col, vec_col).select(F.col("id").alias("query_id"), "v").distinct()
    wanted = asked.join(points.select("v", F.col("cid").alias("own")), "v", "left")
    wanted = cut(wanted.select("query_id", "v", F.xxhash64("v").alias("qid")))
    unique = wanted.select("qid", "v").distinct()
    blocks = max(1, -(-unique.count() // QUERY_BLOCK))

    pack = F.udf(lambda v: np.asarray(v, "<f8").tobytes(), "binary")
    index = points.select(
        "cid", pack("v").alias("vec"), F.size("v").alias("dim"),
        F.pmod(F.xxhash64("cid"), F.lit(shards)).alias("shard"),
    )
    index = cut(
        index.groupBy("dim", "shard").applyInPandas(
            _build, "cid long, vec binary, dim int, shard long, near binary, entry boolean"
        )
    )
    turns = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = index.select("*", turns)
    right = unique.select(
        "qid", pack("v").alias("vec"), F.size("v").alias("dim"),
        F.pmod(F.col("qid"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: _search(a, b, k + 1, beam), "qid long, cid long, score double"
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = found.join(points.select("cid", "members"), "cid").select("qid", "score", "members")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        wanted.join(answers, "qid")
        .select("query_id", "score", F.explode("members").alias("vec_id"))
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    whole = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return (
        df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(whole & F.exists("v", lambda x: x != 0))
    )
