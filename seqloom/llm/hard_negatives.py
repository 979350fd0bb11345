"""Hard-negative mining by cover trees over norm-augmented candidates (operator 11)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import saved, shared_folder

#: So many trees are searched together, from one heap.
FOREST = 8
#: Columns of a tree: its number, then arrays as bytes. A node has a centre, a covering radius, its own rows
#: [own, own_end), its children [child, child_end) and the range of labels below it.
TREE = "tree int, ids binary, labels binary, vecs binary, nodes binary"
NODE = np.dtype([("centre", "<i4"), ("radius", "<f8"), ("own", "<i4"), ("own_end", "<i4"), ("child", "<i4"), ("child_end", "<i4"), ("low", "<i8"), ("high", "<i8")])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of a matrix; those shorter than width are filled up with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """Integer vectors with one more component that gives all of them the norm of the longest.

    Then a small distance is a large inner product: with d the distance of a query (whose own component is 0)
    to a centre, a node of radius r has inner products within <q, c> +- |q| r, and within what the
    distances d - r and d + r say.
    """

    def __init__(self, longest: int, width: int):
        self.longest, self.width = longest, width
        self.kind = next(k for k in ("<i2", "<i4", "<i8") if math.isqrt(longest) <= np.iinfo(k).max)
        self.number = np.float32 if longest < 1 << 23 else np.float64 if longest < 1 << 52 else np.int64  # in which inner products are exact

    def products(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows of x with y (a row, or the columns of a matrix)."""
        return (x.astype(self.number) @ y.astype(self.number)).astype(np.int64)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))])

    def bounds(self, product: np.ndarray, norm2: np.ndarray | float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product below nodes with these products of their centres, safe against rounding."""
        both = norm2 + self.longest
        far, around = np.sqrt(np.maximum(0, both - 2.0 * product)), np.sqrt(norm2) * radius
        slack = 1e-7 * both + 1e-3
        low = np.maximum(product - around, (both - (far + radius) ** 2) / 2) - slack
        return low, np.minimum(product + around, (both - np.maximum(0, far - radius) ** 2) / 2) + slack

    def read(self, data) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, max(1, self.width)).astype(self.number)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def cover_tree(points: np.ndarray, labels: np.ndarray, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points in which a node's rows are together, and the nodes, the root first.

    Levels halve: the children of a node whose points lie within 2**k of its centre are centres more than
    2**(k-1) apart, the node's own centre among them, each with the points within 2**(k-1) that no
    earlier one has. Children of one point stay with their parent, as rows of its own. Radii are those found.
    """
    apart, nodes, order = distances(points, points), [], []
    waiting = [(0, np.arange(len(points)), 0)]  # centre, points, slot of the node
    nodes.append(None)
    while waiting:
        centre, members, slot = waiting.pop()
        radius = float(apart[centre, members].max())
        within, children, own = 2.0 ** (math.ceil(math.log2(radius)) - 1) if radius > 0 else 0.0, [], []
        if len(members) <= leaf or radius == 0:
            own = members.tolist()
        else:
            rest = np.concatenate([[centre], members[members != centre]])
            while len(rest):
                near = apart[rest[0], rest] <= within
                near[0] = True
                if near.sum() > 1:
                    children.append((int(rest[0]), rest[near]))
                else:
                    own.append(int(rest[0]))
                rest = rest[~near]
        first = len(nodes)
        nodes += [None] * len(children)
        below = labels[members]
        # a margin for the rounding of distances, which may be off by a root of the machine's precision near 0
        nodes[slot] = (centre, radius * (1 + 1e-9) + 1e-3, len(order), len(order) + len(own), first, first + len(children), below.min(), below.max())
        order += own
        waiting += [(c, m, first + i) for i, (c, m) in enumerate(children)]
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes = np.array(nodes, NODE)
    nodes["centre"] = place[nodes["centre"]]
    return order, nodes


class Best:
    """The first k of the (score, id) offered within a window of scores: higher scores first, then smaller ids."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = (scores >= self.low) & (scores <= self.high)
        if not fit.any():
            return
        scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        if len(scores) > 8 * self.k:
            cut = np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        first = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.k:
            self.low = max(self.low, self.scores[-1])  # an equal score may still have a smaller id


class Forest:
    """A few trees below one root, which searches descend together."""

    def __init__(self, space: Space, trees: list[dict]):
        self.space = space
        parts = [(np.frombuffer(t["ids"], "<i8"), np.frombuffer(t["labels"], "<i8"), space.read(t["vecs"]), np.frombuffer(t["nodes"], NODE)) for t in trees]
        self.ids, self.labels, self.vecs = (np.concatenate([p[i] for p in parts]) for i in range(3))
        roots, others, row, slot = [], [], 0, 1 + len(parts)
        for ids, _, _, nodes in parts:
            nodes = nodes.copy()
            for name in ("centre", "own", "own_end"):
                nodes[name] += row
            for name in ("child", "child_end"):
                nodes[name] += slot - 1  # the root's place is among the roots
            roots.append(nodes[:1])
            others.append(nodes[1:])
            row, slot = row + len(ids), slot + len(nodes) - 1
        top = np.array([(0, 0.0, 0, 0, 1, 1 + len(parts), 0, 0)], NODE)
        nodes = np.concatenate([top, *roots, *others])
        self.own, self.children = (list(zip(nodes[a].tolist(), nodes[b].tolist(), strict=True)) for a, b in (("own", "own_end"), ("child", "child_end")))
        self.centres, self.radius, self.low, self.high = nodes["centre"], nodes["radius"], nodes["low"], nodes["high"]
        self.below: dict[int, np.ndarray] = {}
        self.norms: dict[int, set[int]] = {}

    def search(self, query: np.ndarray, label: int, same: bool, windows: list[Best]) -> None:
        """Best-first descent: rows of the label (same), or of others, are offered to the windows.

        A node waits by its greatest possible product. It is passed over where its bounds leave no window a row better than
        the window's last, or its labels are none of those asked for.
        """
        norm2 = float(query @ query)

        def open_to(low, high):
            need = np.zeros(np.shape(high), bool)
            for w in windows:
                need |= (low <= w.high) & (np.minimum(high, w.high) >= w.low)
            return need

        heap = [(-np.inf, 0, -np.inf)]
        while heap:
            high, at, low = heapq.heappop(heap)
            if not any(low <= w.high and min(-high, w.high) >= w.low for w in windows):
                continue
            first, last = self.own[at]
            if last > first:
                scores, least, most = self.vecs[first:last] @ query, min(w.low for w in windows), max(w.high for w in windows)
                fit = np.flatnonzero((scores >= least) & (scores <= most) & ((self.labels[first:last] == label) == same))
                if len(fit):
                    scores, ids = scores[fit].astype(np.int64), self.ids[first:last][fit]
                    for w in windows:
                        w.offer(scores, ids)
            first, last = self.children[at]
            if last > first:
                if at not in self.below:
                    self.below[at] = self.vecs[self.centres[first:last]]
                low, high = self.space.bounds((self.below[at] @ query).astype(np.float64), norm2, self.radius[first:last])
                held = (self.low[first:last] <= label) & (label <= self.high[first:last]) if same else (self.low[first:last] != label) | (self.high[first:last] != label)
                for i in np.flatnonzero(held & open_to(low, high)).tolist():
                    heapq.heappush(heap, (-float(high[i]), first + i, float(low[i])))

    def equal(self, query: np.ndarray, ids: list[int], scores: list[int]) -> list[bool]:
        """Whether rows with these ids and products with the query are the query's own vector: then all norms are one."""
        norm2 = int(query.astype(np.int64) @ query.astype(np.int64))
        if norm2 in scores and not self.norms:
            for i, x in zip(self.ids.tolist(), (self.vecs.astype(np.int64) ** 2).sum(1).tolist(), strict=True):
                self.norms.setdefault(i, set()).add(x)
        return [x == norm2 and x in self.norms[i] for i, x in zip(ids, scores, strict=True)]


def trees_of(rows: DataFrame, space: Space) -> DataFrame:
    """One row a tree, from id, label, vec, tree."""

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("id", "ascending")])
        x, labels = matrix(group["vec"].chunk(0), space.width), group["label"].to_numpy()
        order, nodes = cover_tree(space.augmented(x), labels)
        out = [group["tree"][0].as_py(), group["id"].to_numpy()[order].tobytes(), labels[order].tobytes(), x[order].astype(space.kind).tobytes(), nodes.tobytes()]
        return pa.table([pa.array([out[0]], pa.int32()), *(pa.array([v], pa.binary()) for v in out[1:])], names=[c.split()[0] for c in TREE.split(", ")])

    return rows.groupBy("tree").applyInArrow(build, TREE)


def searched(routed: DataFrame, trees: DataFrame, space: Space, k: int, same: bool, blocks: int) -> DataFrame:
    """qid, goal, id, score, own: the first k rows of each query and window, of all the forests that it is sent to.

    routed: forest, qid, label, vec (bytes), windows (goal, low, high). A forest meets the queries sent to it block by block.
    """

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            forest = Forest(space, right.select(["ids", "labels", "vecs", "nodes"]).to_pylist())
            for row in left.to_pylist():
                query, windows = space.read(row["vec"])[0], [Best(k, w["low"], w["high"]) for w in row["windows"]]
                forest.search(query, row["label"], same, windows)
                for w, best in zip(row["windows"], windows, strict=True):
                    ids, scores = best.ids.tolist(), best.scores.tolist()
                    own = forest.equal(query, ids, scores) if same else [False] * len(ids)
                    out += [(row["qid"], w["goal"], *x) for x in zip(ids, scores, own, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qid", "goal", "id", "score", "own"])

    left = routed.withColumn("block", F.expr(f"cast(pmod(xxhash64(qid), {blocks}) as int)"))
    right = trees.withColumns({"forest": F.expr(f"tree div {FOREST}").cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    found = left.groupBy("forest", "block").cogroup(right.groupBy("forest", "block")).applyInArrow(look, "qid long, goal long, id long, score long, own boolean")
    first = Window.partitionBy("qid", "goal").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "vec", label_col: str = "label", positives: int = 5, negatives: int = 10,
    percent: tuple[int, int] = (30, 90), sample: int = 1024, tree_rows: int = 1024, most_cells: int = 256, query_rows: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of integer vectors.

    anchor says which rows are anchors. A score is an inner product; higher ones come first, ties by smaller id.
    An anchor's positives are its first other rows of the same label; for each, the first rows of other labels follow
    whose score is from percent[0] to percent[1] per cent of the positive's (none if that is negative).

    Rows get one more component that gives all the norm of the longest, so that near is a large product. They are
    dealt to the nearest of at most most_cells centres, chosen far apart in a sample of at most `sample` rows; a
    cell's rows make cover trees of about tree_rows rows, as many as the cell needs; a few trees are searched together. Queries, that is the distinct
    vectors and labels of the anchors, go to the cells whose radius leaves room for a better row than the sample has, and
    descend their trees best first; what they find is ranked over all trees. Every row is in a tree and leaves are
    verified exactly, so nothing is missed whatever the sample. Of equal rows of a label only the smallest ids
    that can be returned enter a tree, which spreads a vector that many rows share; it drops nothing.

    Rows with a null id, label, vector or component take no part; labels are integers. Shorter vectors are
    filled up with zeros. Repeated rows are rows of their own: another copy of an anchor is a row like any other.
    Norms must fit 64 bits squared (else an error). An empty table, or one without anchors, gives no rows. Other columns are ignored.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    vec = F.col(vec_col).cast("array<bigint>")
    whole = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"), anchor.alias("anchor"))
    whole = whole.where("id is not null and label is not null and vec is not null").where(~F.exists("vec", lambda x: x.isNull()))
    deep = max(negatives, positives + 1)
    copy = F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))
    norm2 = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x * x)
    kept = saved(whole.select("id", "label", "vec").withColumn("copy", copy).where(F.col("copy") <= deep).drop("copy").withColumn("norm2", norm2), folder, "kept")
    n, longest, width = kept.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.size("vec"))).first()
    space = Space(longest or 0, width or 0)

    # anchors with the same vector and label are one query
    anchors = whole.where("anchor").select("id", "label", "vec")
    queries = saved(anchors.groupBy("vec", "label").agg(F.count(F.lit(1)).alias("n")).select("vec", "label", F.monotonically_increasing_id().alias("qid")), folder, "queries")
    of_anchor = saved(anchors.join(queries, ["vec", "label"]).select(F.col("id").alias("anchor_id"), "qid"), folder, "anchors")
    blocks = max(1, -(-queries.count() // query_rows))

    picked = kept.orderBy(F.xxhash64("id"), "id", F.xxhash64("vec", "label")).limit(sample).select("label", "vec").toArrow().combine_chunks()
    some = matrix(picked["vec"].chunk(0), space.width) if len(picked) else np.empty((0, space.width), np.int64)
    some_labels, points = picked["label"].to_numpy(), space.augmented(some)
    centres, gap = [0] if len(points) else [], None
    while centres and len(centres) < min(most_cells, len(points), -(-n // tree_rows)):
        last = distances(points[centres[-1:]], points)[0]
        gap = last if gap is None else np.minimum(gap, last)
        if gap.max() <= 1e-3:
            break
        centres.append(int(gap.argmax()))
    centre = spark.sparkContext.broadcast((some[centres], points[centres]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = distances(space.augmented(matrix(batch["vec"], space.width)), centre.value[1])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["vec"], pa.array(apart.argmin(1).astype(np.int32)), pa.array(apart.min(1))], names=["id", "label", "vec", "cell", "apart"])

    dealt = saved(kept.select("id", "label", "vec").mapInArrow(deal, "id long, label long, vec array<bigint>, cell int, apart double"), folder, "dealt") if centres else kept.selectExpr("id", "label", "vec", "0 as cell", "0d as apart")
    cells = {r[0]: (-(-r[1] // tree_rows), r[2]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("apart")).collect()}  # at most most_cells rows
    slices, radius = (np.array([cells.get(c, (0, 0.0))[i] for c in range(len(centres))]) for i in (0, 1))
    begins = np.cumsum(slices) - slices
    if not len(centres):
        begins, slices = np.zeros(1, np.int64), np.ones(1, np.int64)
    of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    trees = saved(trees_of(dealt.withColumn("tree", (of(begins) + F.pmod(F.xxhash64("id", "vec"), F.greatest(of(slices), F.lit(1)))).cast("int")).select("tree", "id", "label", "vec"), space), folder, "trees")
    bounds = spark.sparkContext.broadcast((radius * (1 + 1e-9) + 1e-3, begins, slices, some, some_labels))

    def route(k: int, same: bool):
        """Queries with windows, to every forest with trees of the cells that can better what the sample has."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radius, begins, slices, some, some_labels = bounds.value
            kind = pa.list_(pa.struct([("goal", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
            for batch in batches:
                x, labels = matrix(batch["vec"], space.width), batch["label"].to_numpy()
                seen, product = space.products(x, some.T), space.products(x, centre.value[0].T)
                out = []
                for i, goals in enumerate(batch["goals"].to_pylist()):
                    norm2, windows = float((x[i].astype(np.float64) ** 2).sum()), []
                    low, high = space.bounds(product[i].astype(np.float64), norm2, radius)
                    need = np.zeros(len(radius), bool)
                    for goal in goals:
                        first, last = (-(1 << 62), 1 << 62) if same else (-(-percent[0] * goal // 100), percent[1] * goal // 100)
                        mine = seen[i][((some_labels == labels[i]) == same) & (seen[i] >= first) & (seen[i] <= last)]
                        if len(mine) >= k:
                            first = max(first, int(np.partition(mine, -k)[-k]))
                        if first <= last:
                            windows.append({"goal": goal, "low": first, "high": last})
                            need |= (low <= last) & (high >= first)
                    if windows:
                        at = {f for c in np.flatnonzero(need).tolist() for f in range(begins[c] // FOREST, (begins[c] + slices[c] - 1) // FOREST + 1) if slices[c]}
                        out.append((batch["qid"][i].as_py(), int(labels[i]), x[i].astype(space.kind).tobytes(), windows, sorted(at)))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.binary(), kind, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["qid", "label", "vec", "windows", "forests"])

        of_route = "qid long, label long, vec binary, windows array<struct<goal: bigint, low: bigint, high: bigint>>, forests array<int>"
        return lambda q: q.select("qid", "label", "vec", "goals").mapInArrow(send, of_route).select("qid", "label", "vec", "windows", F.explode("forests").alias("forest"))

    nearest = searched(route(positives + 1, True)(queries.withColumn("goals", F.array(F.lit(0).cast("long")))), trees, space, positives + 1, True, blocks)
    nearest = nearest.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "own"))).alias("near"))  # a query's first few
    own = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("anchor_id")) & x["own"]), True)
    others = F.slice(F.filter("near", lambda x, i: i + 1 != F.col("self")), 1, positives)
    pairs = of_anchor.join(nearest, "qid").withColumn("self", own).select("anchor_id", "qid", F.explode(others).alias("p"))
    pairs = saved(pairs.select("anchor_id", "qid", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")), folder, "pairs")

    goals = pairs.where("positive_score >= 0").groupBy("qid").agg(F.collect_set("positive_score").alias("goals"))
    hard = searched(route(negatives, False)(queries.join(goals, "qid")), trees, space, negatives, False, blocks)
    hard = saved(hard.select("qid", F.col("goal").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), folder, "hard")
    return pairs.join(hard, ["qid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
