"""Fixations by a minimum spanning tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.cleaning import decimate, keep_first

DECIMATED_ABOVE = 7000
LEAF = 128
"""Points of one cell of the plane that are compared with those of another at once."""
LEVELS = 20
GAIN = 1e-12


def spanning_tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower end, upper end and weight of each edge of the minimum spanning tree of the complete graph, of any number of points.

    Boruvka's method: in each round every component takes its shortest edge to another one. Points
    lie in cells of at most LEAF; cells are looked through in order of their distance until none can
    hold a nearer point, so the tree is exact, without the graph's edges. Ties go to the edge of the
    lower end, then of the lower other end, which makes the tree unique; points of one place hang on
    the first of them. Memory grows with the points.
    """
    n = len(x)
    order = np.lexsort((y, x))
    fresh = np.ones(n, bool)
    fresh[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    hub = np.empty(n, int)
    hub[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    places = np.flatnonzero(hub == np.arange(n))
    rest = np.flatnonzero(hub != np.arange(n))
    low, high, weights = _place_tree(x[places], y[places])
    return np.concatenate([hub[rest], places[low]]), np.concatenate([rest, places[high]]), np.concatenate([np.zeros(len(rest)), weights])


def _cells(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The points' numbers in cells of at most LEAF, halved along the wider side."""
    cells, waiting = [], [np.arange(len(x))]
    while waiting:
        points = waiting.pop()
        if len(points) <= LEAF:
            cells.append(np.sort(points))
            continue
        along = x if np.ptp(x[points]) >= np.ptp(y[points]) else y
        half = np.argpartition(along[points], len(points) // 2)
        waiting += [points[half[: len(points) // 2]], points[half[len(points) // 2 :]]]
    return cells


def _place_tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of places that all differ."""
    n = len(x)
    cells = _cells(x, y)
    sides = [np.array([f(v[c]) for c in cells]) for v in (x, y) for f in (np.min, np.max)]
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])[:-1]]).astype(int)
    by_cell = np.concatenate(cells)
    component, count = np.arange(n), n
    # distances are squared
    near, distance, stale = np.zeros(n, int), np.zeros(n), np.ones(n, bool)  # of a stale point the distance is a lower bound
    edges = []
    while count > 1:
        best = np.full(count, np.inf)
        np.minimum.at(best, component[~stale], distance[~stale])
        first, last = (f.reduceat(component[by_cell], starts) for f in (np.minimum, np.maximum))
        only = np.where(first == last, first, -1)
        for cell in cells:
            looking = cell[stale[cell] & (distance[cell] <= best[component[cell]])]
            if len(looking):
                w, q = _nearest(x, y, looking, component, best[component[looking]], cells, sides, only)
                found = w <= best[component[looking]]
                distance[looking] = np.where(found, w, best[component[looking]])
                near[looking[found]] = q[found]
                stale[looking[found]] = False
                np.minimum.at(best, component[looking[found]], w[found])
        chosen = np.flatnonzero(~stale & (distance <= best[component]))
        low, high = np.minimum(chosen, near[chosen]), np.maximum(chosen, near[chosen])
        chosen = chosen[np.lexsort((high, low, component[chosen]))]
        chosen = chosen[np.unique(component[chosen], return_index=True)[1]]
        edges.append(np.stack([np.minimum(chosen, near[chosen]), np.maximum(chosen, near[chosen])], 1))
        target = component[near[chosen]]  # chosen holds one point per component, in their order
        own = np.arange(count)
        target = np.where((target[target] == own) & (own < target), own, target)
        while (target != target[target]).any():
            target = target[target]
        roots, renamed = np.unique(target, return_inverse=True)
        component, count = renamed[component], len(roots)
        stale |= component[near] == component
    low, high = np.unique(np.concatenate(edges), axis=0).T if edges else np.zeros((2, 0), int)
    return low, high, np.hypot(x[low] - x[high], y[low] - y[high])


def _nearest(x, y, points, component, bound, cells, sides, only) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and number of the nearest point of another component, exact where it is within bound (squared)."""
    px, py, own = x[points], y[points], component[points]
    left, right, bottom, top = sides
    gap = np.maximum(0, np.maximum(left - px.max(), px.min() - right)) ** 2 + np.maximum(0, np.maximum(bottom - py.max(), py.min() - top)) ** 2
    gap *= 1 - 1e-12
    other = gap <= bound.max()
    if (own == own[0]).all():
        other &= only != own[0]
    candidates = np.flatnonzero(other)
    w, q = np.full(len(points), np.inf), np.full(len(points), len(x))
    rows = np.arange(len(points))
    for c in candidates[np.argsort(gap[candidates], kind="stable")]:
        if gap[c] > np.minimum(w, bound).max():
            break
        members = cells[c]
        d, dy = px[:, None] - x[members], py[:, None] - y[members]
        d *= d
        dy *= dy
        d += dy
        if only[c] < 0 or (own == only[c]).any():
            d[own[:, None] == component[members]] = np.inf
        j = d.argmin(1)
        there, which = d[rows, j], members[j]
        closer = (there < w) | ((there == w) & (which < q))
        w[closer], q[closer] = there[closer], which[closer]
    return w, q


def _depths(n: int, neighbours: list[list[int]], start: int) -> np.ndarray:
    depth = np.full(n, -1)
    depth[start] = 0
    level = [start]
    while level:
        following = []
        for v in level:
            for u in neighbours[v]:
                if depth[u] < 0:
                    depth[u] = depth[v] + 1
                    following.append(u)
        level = following
    return depth


def eccentricities(n: int, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Hops from each vertex of a tree to the farthest: the farther of a longest path's two ends."""
    neighbours: list[list[int]] = [[] for _ in range(n)]
    for p, c in zip(parents.tolist(), children.tolist()):
        neighbours[p].append(c)
        neighbours[c].append(p)
    a = int(np.argmax(_depths(n, neighbours, 0)))
    from_a = _depths(n, neighbours, a)
    return np.maximum(from_a, _depths(n, neighbours, int(np.argmax(from_a))))


def communities(edges: list[tuple[int, int, float]]) -> dict[int, int]:
    """Louvain communities of a weighted graph, vertices and moves in a fixed order."""
    vertices = sorted({v for u, w, _ in edges for v in (u, w)})
    member = {v: v for v in vertices}
    graph: dict[int, dict[int, float]] = {v: {} for v in vertices}
    for u, v, weight in edges:
        graph[u][v] = graph[u].get(v, 0.0) + weight
        graph[v][u] = graph[v].get(u, 0.0) + weight
    for _ in range(LEVELS):
        moved = _one_level(graph)
        if all(c == v for v, c in moved.items()):
            break
        member = {v: moved[c] for v, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(moved.values())}
        for u, links in graph.items():
            for v, weight in links.items():
                merged[moved[u]][moved[v]] = merged[moved[u]].get(moved[v], 0.0) + weight
        graph = merged
    return member


def _one_level(graph: dict[int, dict[int, float]]) -> dict[int, int]:
    degree = {v: sum(links.values()) for v, links in graph.items()}
    total = sum(degree.values())
    community = {v: v for v in graph}
    strength = dict(degree)
    if not total:
        return community
    improved = True
    while improved:
        improved = False
        for v in sorted(graph):
            here = community[v]
            strength[here] -= degree[v]
            towards: dict[int, float] = {here: 0.0}
            for u, weight in graph[v].items():
                if u != v:
                    towards[community[u]] = towards.get(community[u], 0.0) + weight
            gain = lambda c: towards[c] - strength[c] * degree[v] / total  # noqa: B023, E731
            best = max(sorted(towards), key=gain)
            if gain(best) <= gain(here) + GAIN:
                best = here
            strength[best] += degree[v]
            improved |= best != here
            community[v] = best
    return community


def tree_clusters(x: np.ndarray, y: np.ndarray, width: float, height: float) -> tuple[np.ndarray, dict[int, int]]:
    """Each point's eccentricity in the tree, and the clusters of the points that have one: communities of the edges whose ends are both no farther out than the mean."""
    parents, children, weights = spanning_tree(x / width, y / height)
    far = eccentricities(len(x), parents, children)
    central = far <= far.mean()
    kept = central[parents] & central[children]
    return far, communities(list(zip(parents[kept].tolist(), children[kept].tolist(), weights[kept].tolist())))


def cluster_points(x: np.ndarray, y: np.ndarray, width: float, height: float) -> list[tuple[float, float, int]]:
    """Median point and size of each cluster."""
    if len(x) < 3:
        return []
    clusters: dict[int, list[int]] = {}
    for v, c in tree_clusters(x, y, width, height)[1].items():
        clusters.setdefault(c, []).append(v)
    return [(float(np.median(x[m])), float(np.median(y[m])), len(m)) for _, m in sorted(clusters.items())]


def _points(df: DataFrame, keys: list[str], order: str, time: str, size: tuple[str, str]) -> DataFrame:
    points = decimate(keep_first(df, [*keys, "x", "y", time], [order]), keys, order, DECIMATED_ABOVE)
    return points.select(*keys, F.col(order).alias("at"), "x", "y", *[F.col(s).cast("double").alias(n) for s, n in zip(size, ("width", "height"))])


def mst_weight(df: DataFrame, keys: list[str], order: str, time: str, size: tuple[str, str]) -> DataFrame:
    """Points and total weight of each key's tree, coordinates being shares of the window: (keys, n_points, weight).

    A tree is of all of its key's points and found by one task, whatever their number.
    """
    points = _points(df, keys, order, time, size)
    schema = T.StructType([*[points.schema[k] for k in keys], T.StructField("n_points", T.LongType()), T.StructField("weight", T.DoubleType())])

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        weights = spanning_tree((group["x"] / group["width"]).to_numpy(), (group["y"] / group["height"]).to_numpy())[2]
        return group[keys].head(1).assign(n_points=len(group), weight=weights.sum())

    return points.groupBy(*keys).applyInPandas(weigh, schema)


def mst_fixations(df: DataFrame, keys: list[str], order: str, time: str, size: tuple[str, str]) -> DataFrame:
    """Fixations: (keys, cluster, n, x, y), the median points of clusters in the tree of a recording's samples.

    size names the columns of the window's width and height. Samples equal in place and time count
    once; keys with more than DECIMATED_ABOVE samples keep every other one. A key's tree,
    eccentricities and communities are of all its points and found by one task.
    """
    points = _points(df, keys, order, time, size)
    schema = T.StructType([*[points.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in ("cluster", "n")], *[T.StructField(n, T.DoubleType()) for n in ("x", "y")]])

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        found = cluster_points(group["x"].to_numpy(), group["y"].to_numpy(), group["width"].iloc[0], group["height"].iloc[0])
        out = pd.DataFrame(found, columns=["x", "y", "n"]).astype({"x": float, "y": float, "n": int})
        for k in keys:
            out[k] = group[k].iloc[0]
        return out.assign(cluster=np.arange(len(out)))[schema.names]

    return points.groupBy(*keys).applyInPandas(find, schema)


def _by_key(points: DataFrame, keys: list[str], added: list[T.StructField], find) -> DataFrame:
    """find(x, y, width, height) of each key's points by their order, its rows keeping the key's columns."""
    schema = T.StructType([*[points.schema[k] for k in keys], *added])

    def give(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        out = find(group["at"].to_numpy(), group["x"].to_numpy(), group["y"].to_numpy(), group["width"].iloc[0], group["height"].iloc[0])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[schema.names]

    return points.groupBy(*keys).applyInPandas(give, schema)


def tree_edges(df: DataFrame, keys: list[str], order: str, time: str, size: tuple[str, str]) -> DataFrame:
    """The edges of each key's tree: (keys, first, second, weight), the ends by their order."""

    def find(at, x, y, width, height) -> pd.DataFrame:
        low, high, weights = spanning_tree(x / width, y / height)
        return pd.DataFrame({"first": at[low], "second": at[high], "weight": weights})

    added = [T.StructField("first", T.LongType()), T.StructField("second", T.LongType()), T.StructField("weight", T.DoubleType())]
    return _by_key(_points(df, keys, order, time, size), keys, added, find)


def cluster_nodes(df: DataFrame, keys: list[str], order: str, time: str, size: tuple[str, str]) -> DataFrame:
    """Each point with its eccentricity and its cluster, null outside of clusters: (keys, at, eccentricity, cluster)."""

    def find(at, x, y, width, height) -> pd.DataFrame:
        far, member = tree_clusters(x, y, width, height)
        return pd.DataFrame({"at": at, "eccentricity": far, "cluster": pd.array([member.get(v) for v in range(len(x))], dtype="Int64")})

    added = [T.StructField(n, T.LongType()) for n in ("at", "eccentricity", "cluster")]
    return _by_key(_points(df, keys, order, time, size), keys, added, find)
