"""Labels of unlabelled vertices: max-product on trees and general graphs, minimum cut and its randomised vote.

Spins: a message pair (m_neg, m_pos) is indexed by the receiver's label 0 and 1. The factor of an edge of weight w is 0 for equal and -4w for
different labels. An exact tie takes the vertex's influence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components
from spanweave.operators.graph import Graph, both_directions
from spanweave.session import materialize, parallelism

#: Vertices of a component that one task solves; larger trees go level by level through joins.
KERNEL_VERTICES = 200_000
#: Edges of a component that one task floods or cuts; larger ones go round by round through joins.
KERNEL_EDGES = 1_000_000
#: Messages are rounded to so many digits, in joins and in kernels alike, so that a tie is one whatever the order of the sums.
DIGITS = 9
#: Rows of whole components, about, that a task's group takes together.
PACK_ROWS = 50_000


def factor(weight: Column, receiver: Column) -> tuple[Column, Column]:
    """The edge's log factor for a sender of label 0 and of label 1."""
    neg, pos = F.lit(0.0), -4 * weight
    return F.when(receiver <= 0, neg).otherwise(pos), F.when(receiver <= 0, pos).otherwise(neg)


def _packed(df: DataFrame, *key: str) -> DataFrame:
    """Add ``pack``: groups of whole components (``key``), so that many small ones cost one call and a large one is not split."""
    return df.withColumn("pack", F.pmod(F.xxhash64(*key), F.lit(max(parallelism(df.sparkSession), -(-df.count() // PACK_ROWS)))))


def _with_runs(graph: Graph) -> DataFrame:
    """The vertices with ``run`` and ``place``; a single graph is run 0."""
    v = graph.vertices
    return v if "run" in v.columns else v.withColumn("run", F.lit(0).cast("long")).withColumn("place", F.col("vid"))


# --- flooding max-product on general graphs -------------------------------------------------------------------------------------------


def start_messages(graph: Graph) -> DataFrame:
    """Directed messages ``(src, dst, weight, label, other, m_neg, m_pos)``, all zero; ``label`` is the sender's, ``other`` the receiver's."""
    d, lab = both_directions(graph.edges), graph.vertices.select("vid", "label")
    known = d.join(lab.select(F.col("vid").alias("src"), "label"), "src").join(lab.select(F.col("vid").alias("dst"), F.col("label").alias("other")), "dst")
    return known.select("src", "dst", "weight", "label", "other", F.lit(0.0).alias("m_neg"), F.lit(0.0).alias("m_pos"))


def flood_round(messages: DataFrame, normalize: bool = False) -> DataFrame:
    """One synchronous round: every vertex sends along every edge the best of what the others told it.

    What a vertex got over an edge is answered over the same edge: the answer needs the sum of all it got, less this message. So a round is one
    aggregation by receiver and one join back on the same key; the rows turn round.
    """
    total = messages.groupBy("dst").agg(F.sum("m_neg").alias("a_neg"), F.sum("m_pos").alias("a_pos"))
    n_neg, n_pos, far = F.col("a_neg") - F.col("m_neg"), F.col("a_pos") - F.col("m_pos"), -4 * F.col("weight")
    neg = F.when(F.col("other") == 0, n_neg).when(F.col("other") == 1, far + n_pos).otherwise(F.greatest(n_neg, far + n_pos))
    pos = F.when(F.col("other") == 0, far + n_neg).when(F.col("other") == 1, n_pos).otherwise(F.greatest(far + n_neg, n_pos))
    sent = messages.join(total, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.col("other").alias("label"), F.col("label").alias("other"), neg.alias("x_neg"), pos.alias("x_pos"))
    top = F.greatest("x_neg", "x_pos") if normalize else F.lit(0.0)
    return sent.select("src", "dst", "weight", "label", "other", (F.col("x_neg") - top).alias("m_neg"), (F.col("x_pos") - top).alias("m_pos"))


def flood(graph: Graph, rounds: int, normalize: bool = True, digits: int | None = DIGITS, cut_every: int = 4) -> DataFrame:
    """``(src, dst, weight, label, m_neg, m_pos)`` after ``rounds`` rounds; lineage is cut every few rounds. ``digits`` rounds the messages, so that engines that add in another order agree."""
    messages = materialize(start_messages(graph))
    for r in range(1, rounds + 1):
        messages = flood_round(messages, normalize)
        if digits is not None:
            messages = messages.withColumns({c: F.round(c, digits) for c in ("m_neg", "m_pos")})
        if r % cut_every == 0 and r < rounds:
            messages = materialize(messages)
    return messages.drop("other")


def beliefs(messages: DataFrame) -> DataFrame:
    """``(vid, b_neg, b_pos)``: sums of all incoming messages."""
    return messages.groupBy(F.col("dst").alias("vid")).agg(F.sum("m_neg").alias("b_neg"), F.sum("m_pos").alias("b_pos"))


def loop_labels(graph: Graph, messages: DataFrame, digits: int | None = None) -> DataFrame:
    """``(vid, label)`` of every vertex: labelled ones keep theirs, unlabelled ones take the better belief, a tie or no edge the influence."""
    b = beliefs(messages)
    if digits is not None:
        b = b.withColumns({c: F.round(c, digits) for c in ("b_neg", "b_pos")})
    choice = F.when(F.col("b_pos") > F.col("b_neg"), 1).when(F.col("b_neg") > F.col("b_pos"), 0).otherwise(F.col("influence"))
    return graph.vertices.join(b, "vid", "left").select("vid", F.when(F.col("label") >= 0, F.col("label")).otherwise(choice).cast("int").alias("label"))


def _flood_kernel(normalize: bool):
    """Vectorised flooding of whole components in one task, for the round counts that a job per round can't serve; ``rounds`` is the component's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vid = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        s, t = np.searchsorted(vid, pdf["src"]), np.searchsorted(vid, pdf["dst"])
        order = np.lexsort((t, s))
        s, t, w, label, rounds = s[order], t[order], pdf["weight"].to_numpy()[order], pdf["label"].to_numpy()[order], pdf["rounds"].to_numpy()[order]
        m_neg, m_pos = flood_messages(len(vid), s, t, w, label, rounds, normalize)
        return pd.DataFrame({"src": vid[s], "dst": vid[t], "weight": w, "label": label.astype("int32"), "m_neg": m_neg, "m_pos": m_pos})

    return run


def component_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest vertex of each vertex's component."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for v in range(n):
        parent[v] = parent[parent[v]]
    return np.array(parent, dtype=np.int64)


def flood_messages(n: int, s: np.ndarray, t: np.ndarray, w: np.ndarray, label: np.ndarray, rounds: np.ndarray, normalize: bool, every: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Both messages of every directed edge, sorted by (s, t), after its component's ``rounds``; ``label`` is the sender's.

    A component whose messages a round leaves as they were is over, also where they are no numbers any more, as on most graphs with cycles after some
    hundred rounds; now and then the components that are over are left out of the rounds to come.
    """
    out = np.zeros((2, len(s)))
    at, comp = np.arange(len(s)), component_of(n, s, t)[s]
    neg, pos = out.copy()
    sizes, r, last = None, 0, int(rounds.max(initial=0))
    with np.errstate(invalid="ignore", over="ignore"):
        while r < last:
            if sizes is None:  # what follows from the edges that are left
                vid, both = np.unique(np.concatenate([s[at], t[at]]), return_inverse=True)
                sizes, a, b = len(vid), both[: len(at)], both[len(at) :]
                reverse = np.searchsorted(a * sizes + b, b * sizes + a)  # position of each edge's reversed edge
                far, is0, is1, own, of = -4 * w[at], label[at] == 0, label[at] == 1, rounds[at], comp[at]
                least = int(own.min())
            n_neg, n_pos = np.bincount(b, neg, sizes)[a] - neg[reverse], np.bincount(b, pos, sizes)[a] - pos[reverse]
            far_neg, far_pos = n_neg + far, n_pos + far
            new_neg, new_pos = np.maximum(n_neg, far_pos), np.maximum(far_neg, n_pos)
            for new, if0, if1 in ((new_neg, n_neg, far_pos), (new_pos, far_neg, n_pos)):
                np.copyto(new, if0, where=is0)
                np.copyto(new, if1, where=is1)
            if normalize:
                top = np.maximum(new_neg, new_pos)
                new_neg, new_pos = new_neg - top, new_pos - top
            for new in (new_neg, new_pos):
                fine = np.abs(new) < 1e15 * 10.0**-DIGITS  # larger ones have no such digits
                if fine.any():
                    np.copyto(new, np.round(new, DIGITS), where=fine)
            if r >= least:
                np.copyto(new_neg, neg, where=r >= own)
                np.copyto(new_pos, pos, where=r >= own)
            r += 1
            if r % every == 0 or r == last:
                moved = ~((new_neg == neg) | (np.isnan(new_neg) & np.isnan(neg))) | ~((new_pos == pos) | (np.isnan(new_pos) & np.isnan(pos)))
                live = np.isin(of, of[moved])
                if not live.all() or r == last:
                    out[:, at] = new_neg, new_pos
                    if not live.any():
                        break
                    at, neg, pos, sizes = at[live], new_neg[live], new_pos[live], None
                    continue
            neg, pos = new_neg, new_pos
    return out[0], out[1]


def flood_exact(graph: Graph, threshold: int | None = None, normalize: bool = False, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Messages after ``threshold + 1`` rounds, by default twice the number of edges of the whole graph (its run), plus one; without normalisation.

    Unnormalised messages of long runs on graphs with cycles grow without bound until only the influence decides; :func:`flood` with ``normalize`` is the
    stable variant. Components are independent; those of up to ``kernel_edges`` edges are solved whole in tasks, larger ones by joins, round after round.
    """
    runs = _with_runs(graph).select(F.col("vid").alias("src"), "run")
    if threshold is None:
        number = graph.edges.join(runs, "src").groupBy("run").agg((2 * F.count(F.lit(1)) + 1).cast("int").alias("rounds"))
        rounds = runs.join(number, "run")
    else:
        rounds = runs.withColumn("rounds", F.lit(threshold + 1))
    messages = start_messages(graph).join(rounds.select("src", "rounds"), "src")
    comp = connected_components(graph.edges.select("src", "dst"))
    with_comp = materialize(messages.join(comp.select(F.col("node").alias("src"), "component"), "src"))
    large = with_comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * kernel_edges).select("component")
    if large.isEmpty():
        return _flood_components(with_comp, normalize)
    out = _flood_components(with_comp.join(large, "component", "left_anti"), normalize)
    inside = materialize(with_comp.join(large, "component", "left_semi").where("src < dst"))
    for r in inside.select("rounds").distinct().collect():  # a row per run with so large a component
        mine = inside.where(F.col("rounds") == r["rounds"]).select("src", "dst", "weight")
        out = out.unionByName(flood(Graph(graph.vertices, materialize(mine)), r["rounds"], normalize))
    return out


def _flood_components(with_comp: DataFrame, normalize: bool) -> DataFrame:
    return _packed(with_comp, "component").groupBy("pack").applyInPandas(_flood_kernel(normalize), "src long, dst long, weight double, label int, m_neg double, m_pos double")


# --- exact max-product on forests ------------------------------------------------------------------------------------------------------


def _pick(neg: float, pos: float, influence: int) -> int:
    return influence if neg == pos else int(pos > neg)


def walk_tree(vid: list[int], label: list[int], influence: list[int], edges: list[tuple[int, int, float]]) -> tuple[dict, ...]:
    """One tree: breadth-first from the lowest vertex (neighbours in id order), messages from the leaves, labels from the root; ``(parent, depth, message, trace, label)`` by vertex."""
    near: dict[int, list[tuple[int, float]]] = {v: [] for v in vid}
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    lab, inf = dict(zip(vid, label, strict=True)), dict(zip(vid, influence, strict=True))
    root = min(vid)
    parent, up, depth, route = {root: root}, {root: 0.0}, {root: 0}, [root]
    for v in route:
        for u, w in sorted(near[v]):
            if u not in parent:
                parent[u], up[u], depth[u] = v, w, depth[v] + 1
                route.append(u)
    inc = {v: [0.0, 0.0] for v in route}
    message, trace = {}, {}
    for v in reversed(route):
        n, w = inc[v], up[v]
        rows = ((n[0], n[1] - 4 * w), (n[0] - 4 * w, n[1]))
        picks = [lab[v]] * 2 if lab[v] >= 0 else [_pick(*r, inf[v]) for r in rows]
        trace[v], message[v] = picks, [rows[0][picks[0]], rows[1][picks[1]]]
        if parent[v] != v:
            inc[parent[v]][0] += message[v][0]
            inc[parent[v]][1] += message[v][1]
    out: dict[int, int] = {}
    for v in route:
        out[v] = lab[v] if lab[v] >= 0 else trace[v][0 if v == root else out[parent[v]]]
    return parent, depth, message, trace, out


def solve_tree(vid: list[int], label: list[int], influence: list[int], edges: list[tuple[int, int, float]]) -> pd.DataFrame:
    parent, depth, message, trace, out = walk_tree(vid, label, influence, edges)
    route = list(out)
    return pd.DataFrame(
        {
            "vid": route,
            "component": route[0],
            "parent": [parent[v] for v in route],
            "depth": [depth[v] for v in route],
            "m_neg": [float(message[v][0]) for v in route],
            "m_pos": [float(message[v][1]) for v in route],
            "t_neg": [trace[v][0] for v in route],
            "t_pos": [trace[v][1] for v in route],
            "label": [out[v] for v in route],
        }
    )


TREE = "vid long, component long, parent long, depth int, m_neg double, m_pos double, t_neg int, t_pos int, label int"


def _tree_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    edges = {c: list(zip(e["src"].astype(int), e["dst"].astype(int), e["weight"], strict=True)) for c, e in pdf[pdf["dst"].notna()].groupby("component")}
    trees = pdf[pdf["dst"].isna()].groupby("component")
    return pd.concat([solve_tree(v["src"].astype(int).tolist(), v["label"].astype(int).tolist(), v["influence"].astype(int).tolist(), edges.get(c, [])) for c, v in trees], ignore_index=True)


def _forest_components(graph: Graph) -> DataFrame:
    comp = connected_components(graph.edges.select("src", "dst"))
    vertices = graph.vertices.select("vid", "label", "influence").join(comp.withColumnRenamed("node", "vid"), "vid", "left")
    return materialize(vertices.withColumn("component", F.coalesce("component", "vid")))


def tree_inference(graph: Graph, kernel_vertices: int = KERNEL_VERTICES) -> DataFrame:
    """``(vid, component, parent, depth, m_neg, m_pos, t_neg, t_pos, label)`` of every vertex of a forest.

    A root is the lowest vertex of its component and its own parent. Components up to ``kernel_vertices`` are solved in one task each, larger ones by
    level-wise joins, with the same result. Edges that form a cycle are refused.
    """
    vertices = _forest_components(graph)
    n, c, e = vertices.count(), vertices.select("component").distinct().count(), graph.edges.count()
    if e != n - c:
        raise ValueError(f"not a forest: {e} edges, {n} vertices in {c} components")
    sizes = vertices.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = vertices.join(sizes, "component")
    small, large = sized.where(F.col("size") <= kernel_vertices), sized.where(F.col("size") > kernel_vertices)
    rows = small.select("component", F.col("vid").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), "label", "influence")
    inner = graph.edges.join(small.select(F.col("vid").alias("src"), "component"), "src").select("component", "src", "dst", "weight", F.lit(None).cast("int").alias("label"), F.lit(None).cast("int").alias("influence"))
    solved = _packed(rows.unionByName(inner), "component").groupBy("pack").applyInPandas(_tree_kernel, TREE)
    if large.isEmpty():
        return solved
    return solved.unionByName(_tree_by_levels(large.drop("size"), graph.edges.join(large.select(F.col("vid").alias("src")), "src")))


def _tree_by_levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by one join per level: breadth-first down, messages up, labels down."""
    near = materialize(both_directions(edges))
    roots = vertices.where("vid = component").select("vid", F.col("vid").alias("parent"), F.lit(0.0).alias("w"), F.lit(0).alias("depth"))
    levels = [materialize(roots)]
    while True:
        last = levels[-1]
        nxt = last.select(F.col("vid").alias("src"), F.col("parent").alias("pp"), "depth").join(near, "src").where("dst <> pp")
        nxt = materialize(nxt.select(F.col("dst").alias("vid"), F.col("src").alias("parent"), F.col("weight").alias("w"), (F.col("depth") + 1).alias("depth")))
        if nxt.isEmpty():
            break
        levels.append(nxt)
    info = vertices.select("vid", "component", "label", "influence")
    sent: list[DataFrame] = []
    for level in reversed(levels):
        here = level.join(info, "vid")
        if sent:
            inc = sent[-1].where("parent <> vid").groupBy(F.col("parent").alias("vid")).agg(F.sum("m_neg").alias("i_neg"), F.sum("m_pos").alias("i_pos"))
            here = here.join(inc, "vid", "left").fillna(0.0, ["i_neg", "i_pos"])
        else:
            here = here.withColumns({"i_neg": F.lit(0.0), "i_pos": F.lit(0.0)})
        far = -4 * F.col("w")
        n_neg, n_pos = F.col("i_neg"), F.col("i_pos")

        def choose(a: Column, b: Column) -> Column:
            free = F.when(a == b, F.col("influence")).when(b > a, 1).otherwise(0)
            return F.when(F.col("label") >= 0, F.col("label")).otherwise(free).cast("int")

        here = here.withColumns({"t_neg": choose(n_neg, far + n_pos), "t_pos": choose(far + n_neg, n_pos)})
        here = here.withColumns({"m_neg": F.when(F.col("t_neg") == 0, n_neg).otherwise(far + n_pos), "m_pos": F.when(F.col("t_pos") == 0, far + n_neg).otherwise(n_pos)})
        sent.append(materialize(here.drop("i_neg", "i_pos")))
    out: list[DataFrame] = []
    for here in reversed(sent):
        if not out:
            chosen = here.withColumn("out", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col("t_neg")))
        else:
            above = out[-1].select(F.col("vid").alias("parent"), F.col("out").alias("above"))
            chosen = here.join(above, "parent").withColumn("out", F.when(F.col("label") >= 0, F.col("label")).when(F.col("above") == 0, F.col("t_neg")).otherwise(F.col("t_pos"))).drop("above")
        out.append(materialize(chosen))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total.select("vid", "component", "parent", "depth", "m_neg", "m_pos", "t_neg", "t_pos", F.col("out").alias("label"))


# --- minimum cut -----------------------------------------------------------------------------------------------------------------------


def terminal_capacities(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(vid, c_pos, c_neg)`` of unlabelled vertices: their weights to labels 1 and 0. Labelled vertices contracted into the two terminals leave the
    same minimum cuts, which then split over the components of the unlabelled vertices."""
    lab = vertices.select("vid", "label")
    d = both_directions(edges).join(lab.select(F.col("vid").alias("dst"), "label"), "dst").where("label >= 0")
    sums = d.groupBy(F.col("src").alias("vid")).agg(F.sum(F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)).alias("c_pos"), F.sum(F.when(F.col("label") == 0, F.col("weight")).otherwise(0.0)).alias("c_neg"))
    return vertices.where("label < 0").select("vid").join(sums, "vid", "left").fillna(0.0, ["c_pos", "c_neg"])


def max_flow_side(n: int, source: np.ndarray, sink: np.ndarray, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, float]:
    """Source-minimal side of a minimum cut (Dinic's algorithm, iterative): 1 for vertices still reachable from the source, and the flow."""
    s, t, eps = n, n + 1, 1e-12
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    flow = 0.0
    for v in range(n):
        through = min(source[v], sink[v])  # flows straight through
        flow += through
        if source[v] > through:
            arc(s, v, float(source[v] - through), 0.0)
        if sink[v] > through:
            arc(v, t, float(sink[v] - through), 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for v in queue:
            for e in head[v]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([int(level[v] >= 0) for v in range(n)]), flow
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                push = min(cap[e] for e in path)
                flow += push
                cut = 0
                for k, e in enumerate(path):
                    cap[e] -= push
                    cap[e ^ 1] += push
                for k, e in enumerate(path):
                    if cap[e] <= eps:
                        cut = k
                        break
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[v] < len(head[v]) and not (cap[head[v][at[v]]] > eps and level[to[head[v][at[v]]]] == level[v] + 1):
                at[v] += 1
            if at[v] < len(head[v]):
                path.append(head[v][at[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                at[v] += 1
            else:
                break


def _cut_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_cut_replicate(part) for _, part in pdf.groupby("rep")], ignore_index=True)


def _cut_replicate(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of one replicate: cut together, as separate ones have separate flows."""
    v, e = pdf[pdf["dst"].isna()], pdf[pdf["dst"].notna()]
    vid = v["src"].to_numpy().astype(np.int64)
    order = np.argsort(vid)
    vid = vid[order]
    a, b = np.searchsorted(vid, e["src"].to_numpy().astype(np.int64)), np.searchsorted(vid, e["dst"].to_numpy().astype(np.int64))
    side, _ = max_flow_side(len(vid), v["c_pos"].to_numpy()[order], v["c_neg"].to_numpy()[order], list(zip(a.tolist(), b.tolist(), e["weight"].tolist(), strict=True)))
    return pd.DataFrame({"rep": int(pdf["rep"].iloc[0]), "vid": vid, "side": side.astype("int32")})


def _cuts(vertices: DataFrame, edges: DataFrame, cuts: int, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``(rep, vid, side)`` for ``edges(rep, src, dst, weight)`` with rep 0 to ``cuts``: a minimum cut per replicate, of all the one with the smallest side 1.

    A component of unlabelled vertices with up to ``kernel_edges`` edges is one task; a larger one is cut by parallel push-relabel over joins.
    """
    lab = vertices.select("vid", "label")
    free = lab.where("label < 0").select("vid")
    ends = edges.join(lab.select(F.col("vid").alias("src"), F.col("label").alias("ls")), "src").join(lab.select(F.col("vid").alias("dst"), F.col("label").alias("ld")), "dst")
    ends = materialize(ends)
    inner = ends.where("ls < 0 and ld < 0").select("rep", "src", "dst", "weight")
    comp = connected_components(inner.select("src", "dst"))
    comp = materialize(free.join(comp.withColumnRenamed("node", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid")))
    out = ends.where("ls < 0 and ld >= 0").select("rep", F.col("src").alias("vid"), F.col("ld").alias("t"), "weight")
    out = out.unionAll(ends.where("ld < 0 and ls >= 0").select("rep", F.col("dst").alias("vid"), F.col("ls").alias("t"), "weight"))
    caps = out.groupBy("rep", "vid").agg(F.sum(F.when(F.col("t") == 1, F.col("weight")).otherwise(0.0)).alias("c_pos"), F.sum(F.when(F.col("t") == 0, F.col("weight")).otherwise(0.0)).alias("c_neg"))
    every = comp.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cuts)))).join(caps, ["rep", "vid"], "left").fillna(0.0, ["c_pos", "c_neg"])
    links = inner.join(comp.select(F.col("vid").alias("src"), "component"), "src")
    large = materialize(links.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > (cuts + 1) * kernel_edges).select("component"))
    if large.isEmpty():
        return _cut_components(every, links)
    small = _cut_components(every.join(large, "component", "left_anti"), links.join(large, "component", "left_anti"))
    return small.unionByName(_push_relabel(every.join(large, "component", "left_semi"), links.join(large, "component", "left_semi")))


def _cut_components(every: DataFrame, links: DataFrame) -> DataFrame:
    rows = every.select("rep", "component", F.col("vid").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), "c_pos", "c_neg")
    inside = links.select("rep", "component", "src", "dst", "weight", F.lit(0.0).alias("c_pos"), F.lit(0.0).alias("c_neg"))
    return _packed(rows.unionByName(inside), "rep", "component").groupBy("pack").applyInPandas(_cut_kernel, "rep int, vid long, side int")


def _push_relabel(every: DataFrame, links: DataFrame, max_rounds: int = 100_000, pulses: int = 4) -> DataFrame:
    """Parallel push-relabel (Goldberg, Tarjan 1988) as joins, all components and replicates at once.

    Flow runs from terminal 0 to terminal 1: each vertex starts with the excess of its weight to label 0, and ``t`` is what it can still pass to label 1.
    A round finds the vertices' residual distances to terminal 1 breadth-first, then lets active vertices push along arcs that come one step
    nearer, a few times. When no active vertex has a distance, the preflow is maximal, and the vertices with a distance are the smallest side 1 of any
    minimum cut.
    """
    key = ["rep", "vid"]
    eps = 1e-12
    through = F.least("c_pos", "c_neg")
    nodes = materialize(every.select("rep", "vid", (F.col("c_neg") - through).alias("excess"), (F.col("c_pos") - through).alias("t")))
    arcs = links.select("rep", F.col("src").alias("vid"), F.col("dst").alias("to"), F.col("weight").alias("cap"))
    arcs = materialize(arcs.unionAll(links.select("rep", F.col("dst").alias("vid"), F.col("src").alias("to"), F.col("weight").alias("cap"))))
    for _ in range(max_rounds):
        level = materialize(nodes.where(F.col("t") > eps).select(*key, F.lit(1).alias("d")))
        seen, front, depth = level, level, 1
        while not front.isEmpty():
            depth += 1
            back = arcs.where(F.col("cap") > eps).join(front.select("rep", F.col("vid").alias("to")), ["rep", "to"]).select(*key).distinct()
            front = materialize(back.join(seen, key, "left_anti").withColumn("d", F.lit(depth)))
            seen = materialize(seen.unionByName(front))
        reach = seen
        if nodes.where(F.col("excess") > eps).join(reach, key).isEmpty():
            return nodes.join(reach, key, "left").select("rep", "vid", F.col("d").isNotNull().cast("int").alias("side"))
        for _ in range(pulses):
            # into the terminal first
            nodes = nodes.withColumn("f", F.least("excess", "t")).select(*key, (F.col("excess") - F.col("f")).alias("excess"), (F.col("t") - F.col("f")).alias("t"))
            active = nodes.where(F.col("excess") > eps).join(reach, key)
            down = arcs.where(F.col("cap") > eps).join(active, key).join(reach.select("rep", F.col("vid").alias("to"), F.col("d").alias("dt")), ["rep", "to"]).where("dt = d - 1")
            before = F.coalesce(F.sum("cap").over(Window.partitionBy(*key).orderBy("to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            flow = down.select(*key, "to", F.greatest(F.lit(0.0), F.least(F.col("cap"), F.col("excess") - before)).alias("f")).where(F.col("f") > 0)
            flow = materialize(flow)
            if flow.isEmpty():
                nodes = materialize(nodes)
                break
            moved = flow.unionAll(flow.select("rep", F.col("to").alias("vid"), F.col("vid").alias("to"), (-F.col("f")).alias("f"))).groupBy("rep", "vid", "to").agg(F.sum("f").alias("f"))
            moved = materialize(moved)
            arcs = materialize(arcs.join(moved, ["rep", "vid", "to"], "left").select("rep", "vid", "to", (F.col("cap") - F.coalesce("f", F.lit(0.0))).alias("cap")))
            net = moved.groupBy(*key).agg(F.sum("f").alias("f"))
            nodes = materialize(nodes.join(net, key, "left").select(*key, (F.col("excess") - F.coalesce("f", F.lit(0.0))).alias("excess"), "t"))
    raise RuntimeError(f"no minimum cut after {max_rounds} rounds")


def mincut_labels(graph: Graph, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """``(vid, label)``: labelled vertices keep theirs; of all minimum cuts the one with the smallest side of label 1."""
    cut = _cuts(graph.vertices, graph.edges.select(F.lit(0).alias("rep"), "src", "dst", "weight"), 0, kernel_edges)
    return graph.vertices.join(cut.select("vid", "side"), "vid", "left").select("vid", F.when(F.col("label") >= 0, F.col("label")).otherwise(F.col("side")).cast("int").alias("label"))


def cut_value(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(value)``: the sum of the weights between different labels."""
    a = labels.select(F.col("vid").alias("src"), F.col("label").alias("x"))
    b = labels.select(F.col("vid").alias("dst"), F.col("label").alias("y"))
    return edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.when(F.col("x") != F.col("y"), F.col("weight"))), F.lit(0.0)).alias("value"))


def flow_value(graph: Graph) -> DataFrame:
    """``(flow)``: the largest flow between the two terminals, found apart from any cut; components must fit in a task each."""
    lab = graph.vertices.select("vid", "label")
    ends = graph.edges.join(lab.select(F.col("vid").alias("src"), F.col("label").alias("ls")), "src").join(lab.select(F.col("vid").alias("dst"), F.col("label").alias("ld")), "dst")
    direct = ends.where("ls >= 0 and ld >= 0 and ls <> ld").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("flow"))
    inner = ends.where("ls < 0 and ld < 0").select("src", "dst", "weight")
    comp = connected_components(inner.select("src", "dst")).withColumnRenamed("node", "src")
    caps = terminal_capacities(graph.vertices, graph.edges).withColumnRenamed("vid", "src")
    rows = caps.join(comp, "src", "left").select(F.coalesce("component", "src").alias("component"), "src", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"), "c_pos", "c_neg")
    links = inner.join(comp, "src").select("component", "src", "dst", "weight", F.lit(0.0).alias("c_pos"), F.lit(0.0).alias("c_neg"))
    parts = materialize(rows.unionByName(links))
    most = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > 2 * KERNEL_EDGES:
        raise ValueError(f"a component of {most} rows is too large for one task")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        v, e = pdf[pdf["dst"].isna()].sort_values("src"), pdf[pdf["dst"].notna()]
        vid = v["src"].to_numpy().astype(np.int64)
        a, b = (np.searchsorted(vid, e[c].to_numpy().astype(np.int64)).tolist() for c in ("src", "dst"))
        return pd.DataFrame({"flow": [max_flow_side(len(vid), v["c_pos"].to_numpy(), v["c_neg"].to_numpy(), list(zip(a, b, e["weight"].tolist(), strict=True)))[1]]})

    flows = _packed(parts, "component").groupBy("pack").applyInPandas(kernel, "flow double")
    return flows.union(direct).agg(F.sum("flow").alias("flow"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the joined parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def noisy_edges(edges: DataFrame, cuts: int = 4, share: float = 0.3, low: float = -0.6, high: float = 0.4, seed: int = 0, ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """``(rep, src, dst, weight)``: the graph itself as replicate 0 and ``cuts`` copies, where an edge is moved with probability ``share`` by a uniform number in
    [low, high); weights don't fall below 0. ``ends`` name the columns whose numbers the noise derives from."""
    r = edges.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cuts))))
    hit = uniform(F.lit(seed), F.lit("hit"), F.col("rep"), *map(F.col, ends)) < share
    by = F.lit(low) + (high - low) * uniform(F.lit(seed), F.lit("by"), F.col("rep"), *map(F.col, ends))
    return r.select("rep", "src", "dst", F.when((F.col("rep") > 0) & hit, F.greatest(F.col("weight") + by, F.lit(0.0))).otherwise(F.col("weight")).alias("weight"))


def accepted_cuts(sides: DataFrame, n: int | DataFrame, balance: float = 0.06) -> DataFrame:
    """``(rep, size)``: the base cut always, another if its side of label 1, the terminal counted, is between ``balance`` and 1 - ``balance`` of the n + 2 vertices.

    Of many graphs ``sides`` has ``run``, ``n`` is ``(run, n)``, and so the result has ``run``.
    """
    if isinstance(n, int):
        size = sides.groupBy("rep").agg((F.sum("side") + 1).alias("size")).withColumn("n", F.lit(n))
    else:
        size = sides.groupBy("run", "rep").agg((F.sum("side") + 1).alias("size")).join(n, "run")
    return size.where((F.col("rep") == 0) | F.col("size").between(balance * (F.col("n") + 2), (1 - balance) * (F.col("n") + 2))).drop("n")


def randomized_mincut(graph: Graph, cuts: int = 4, seed: int = 0, balance: float = 0.06) -> DataFrame:
    """``(vid, label, votes, accepted)``: majority of the accepted cuts; all replicates are solved in one job."""
    vertices = _with_runs(graph)
    place = vertices.select("vid", "place")
    edges = graph.edges.join(place.select(F.col("vid").alias("src"), F.col("place").alias("from")), "src").join(place.select(F.col("vid").alias("dst"), F.col("place").alias("to")), "dst")
    sides = _cuts(graph.vertices, noisy_edges(edges, cuts, seed=seed, ends=("from", "to")), cuts).select("rep", "vid", "side")
    fixed = graph.vertices.where("label >= 0").select(F.explode(F.sequence(F.lit(0), F.lit(cuts))).alias("rep"), "vid", F.col("label").alias("side"))
    every = materialize(sides.unionByName(fixed).join(vertices.select("vid", "run"), "vid"))
    good = accepted_cuts(every, vertices.groupBy("run").agg(F.count(F.lit(1)).alias("n")), balance)
    number = good.groupBy("run").agg(F.count(F.lit(1)).cast("int").alias("accepted"))
    good = materialize(good.select("run", "rep").join(number, "run"))  # at most cuts + 1 rows a run
    votes = every.join(good, ["run", "rep"]).groupBy("vid").agg(F.sum("side").alias("votes"), F.first("accepted").alias("accepted"))
    return votes.select("vid", (F.col("votes") > F.floor(F.col("accepted") / 2)).cast("int").alias("label"), "votes", "accepted")


# --- one whole graph in a task ---------------------------------------------------------------------------------------------------------


def _md5_share(text: str) -> float:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:8], 16) / 4294967296.0


def noise_of(src: np.ndarray, dst: np.ndarray, cuts: int = 4, share: float = 0.3, low: float = -0.6, high: float = 0.4, seed: int = 0, known: dict | None = None) -> np.ndarray:
    """What :func:`noisy_edges` adds to each edge's weight, a row per copy; ``known`` keeps numbers for the next graph with the same edges."""
    known = {} if known is None else known
    out = np.zeros((cuts, len(src)))
    for e, (a, b) in enumerate(zip(src.tolist(), dst.tolist(), strict=True)):
        if (a, b) not in known:
            known[a, b] = [low + (high - low) * _md5_share(f"{seed}:by:{rep}:{a}:{b}") if _md5_share(f"{seed}:hit:{rep}:{a}:{b}") < share else 0.0 for rep in range(1, cuts + 1)]
        out[:, e] = known[a, b]
    return out


def _cut_side(label: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Side of every vertex in the minimum cut of least side 1; labelled ones keep their label."""
    free, n = label < 0, len(label)
    place = np.cumsum(free) - 1
    a, b, w2 = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    caps = [np.bincount(a[label[b] == c], w2[label[b] == c], n)[free] for c in (1, 0)]
    inner = free[src] & free[dst]
    links = list(zip(place[src[inner]].tolist(), place[dst[inner]].tolist(), weight[inner].tolist(), strict=True))
    out = label.copy()
    out[free] = max_flow_side(int(free.sum()), *caps, links)[0]
    return out


def _cut_votes(label: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, base: np.ndarray, known: dict, balance: float = 0.06) -> np.ndarray:
    """Labels of :func:`randomized_mincut` from ``base``, the cut of the graph itself."""
    n, sides = len(label) + 2, [base]
    for moved in noise_of(src, dst, known=known):
        side = _cut_side(label, src, dst, np.where(moved != 0, np.maximum(weight + moved, 0.0), weight))
        if balance * n <= side.sum() + 1 <= (1 - balance) * n:
            sides.append(side)
    return (np.sum(sides, 0) > len(sides) // 2).astype(np.int64)


def _tree_labels(label: np.ndarray, influence: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    comp = component_of(len(label), src, dst)
    trees = np.unique(comp)
    if len(src) != len(label) - len(trees):
        raise ValueError(f"not a forest: {len(src)} edges, {len(label)} vertices in {len(trees)} components")
    members: dict[int, list[int]] = {c: [] for c in trees.tolist()}
    edges: dict[int, list[tuple[int, int, float]]] = {c: [] for c in members}
    for v, c in enumerate(comp.tolist()):
        members[c].append(v)
    for c, *edge in zip(comp[src].tolist(), src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        edges[c].append(tuple(edge))
    out = np.empty(len(label), np.int64)
    for c, vid in members.items():
        solved = walk_tree(vid, label[vid].tolist(), influence[vid].tolist(), edges[c])[-1]
        out[list(solved)] = list(solved.values())
    return out


def _loop_labels(label: np.ndarray, influence: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, rounds: int, normalize: bool) -> np.ndarray:
    """Labels of :func:`loop_labels`; as in SQL, what is no number is above all numbers and equal to itself."""
    s, t, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    order = np.lexsort((t, s))
    s, t, w = s[order], t[order], w[order]
    messages = flood_messages(len(label), s, t, w, label[s], np.full(len(s), rounds), normalize)
    with np.errstate(invalid="ignore", over="ignore"):
        neg, pos = (np.bincount(t, m, len(label)) for m in messages)
    above = lambda x, y: (x > y) | (np.isnan(x) & ~np.isnan(y))
    return np.where(label >= 0, label, np.where(above(pos, neg), 1, np.where(above(neg, pos), 0, influence)))


class Solver:
    """Labels of graphs over the same vertices, numbered from 0 as in ``place``: what :data:`MODELS` give, each graph whole in this task.

    Graphs that are equal, as forests of several k often are, are solved once.
    """

    def __init__(self, label: np.ndarray, influence: np.ndarray):
        self.label, self.influence = label.astype(np.int64), influence.astype(np.int64)
        self.noise: dict = {}
        self.done: dict[tuple, np.ndarray] = {}

    def labels(self, model: str, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """``src < dst``, each edge once."""
        key = (model, src.tobytes(), dst.tobytes(), weight.tobytes())
        if key not in self.done:
            self.done[key] = self._solve(model, src, dst, weight)
        return self.done[key]

    def _solve(self, model: str, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        edges = (src, dst, weight)
        if model == "mincut":
            return _cut_side(self.label, *edges)
        if model == "mincut_randomize":
            return _cut_votes(self.label, *edges, self.labels("mincut", *edges), self.noise)
        if model == "graphical_tree":
            return _tree_labels(self.label, self.influence, *edges)
        if model == "graphical_loop":
            return _loop_labels(self.label, self.influence, *edges, 2 * len(src) + 1, False)
        if model == "graphical_loop_stable":
            return _loop_labels(self.label, self.influence, *edges, 201, True)
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")


# --- dispatch --------------------------------------------------------------------------------------------------------------------------

#: Model name -> callable(graph) -> (vid, label, ...).
MODELS = {
    "mincut": mincut_labels,
    "mincut_randomize": randomized_mincut,
    "graphical_tree": tree_inference,
    "graphical_loop": lambda graph: loop_labels(graph, flood_exact(graph)),
    "graphical_loop_stable": lambda graph: loop_labels(graph, flood_exact(graph, threshold=200, normalize=True)),
}


def infer(graph: Graph, model: str = "mincut") -> DataFrame:
    """``(vid, label)`` of every vertex by a named model."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
    return MODELS[model](graph).select("vid", "label")


def unlabelled_predictions(graph: Graph, labels: DataFrame) -> DataFrame:
    """``(vid, predicted)`` of the unlabelled vertices."""
    return graph.vertices.where("label < 0").select("vid").join(labels.select("vid", F.col("label").alias("predicted")), "vid")
