"""Near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import components, stored, union_roots

#: Rows of a block: a tree has one, and two trees are traversed together.
BLOCK_ROWS = 1024
#: Rows that meet their pivots in one task.
DEAL_ROWS = 8192
#: Most pivots a group of equal labels is dealt around. Cells that stay large are cut in blocks.
PIVOTS = 256
#: Bounds are widened by this, far over the rounding of a distance; a node of a smaller radius is not split.
SLACK = 1e-6
#: Node pairs that are looked at together.
PAIRS = 500_000

CELLS = "label string, cell int, key long, unit binary, far double"
FOUND = "key long, n long, other long"


@dataclass
class Tree:
    """Nodes in order of depth. A node covers members[low:high], all within radius of its center; the centers of a level
    are among those of the next, whose radii are half as large."""

    members: np.ndarray
    center: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    def add(self, center: int, low: int, high: int, distance: np.ndarray) -> None:
        self.center.append(center)
        self.low.append(low)
        self.high.append(high)
        self.radius.append(float(distance[center, self.members[low:high]].max()))
        self.first.append(len(self.center) - 1)  # a node that is not split is its own child
        self.last.append(len(self.center))

    def arrays(self) -> None:
        for name in ("center", "radius", "low", "high", "first", "last"):
            setattr(self, name, np.array(getattr(self, name)))


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))


def build(units: np.ndarray) -> Tree:
    """The cover tree of unit vectors."""
    n = len(units)
    distance = _distance(units @ units.T)
    np.fill_diagonal(distance, 0.0)
    tree = Tree(np.arange(n))
    tree.add(0, 0, n, distance)
    level, reach = [0], 2.0
    while level:
        reach /= 2
        below = []
        for node in level:
            if tree.radius[node] <= SLACK or tree.high[node] - tree.low[node] == 1:
                continue
            low, high = tree.low[node], tree.high[node]
            members = tree.members[low:high]
            owner = np.full(len(members), -1)
            centers = [tree.center[node]]
            owner[distance[centers[0], members] <= reach] = 0
            while (owner < 0).any():
                c = int(members[np.argmax(owner < 0)])
                owner[(distance[c, members] <= reach) & (owner < 0)] = len(centers)
                centers.append(c)
            order = np.argsort(owner, kind="stable")
            tree.members[low:high] = members[order]
            ends = low + np.cumsum(np.bincount(owner, minlength=len(centers)))
            tree.first[node] = len(tree.center)
            for c, a, b in zip(centers, [low, *ends[:-1].tolist()], ends.tolist()):
                below.append(len(tree.center))
                tree.add(c, a, b, distance)
            tree.last[node] = len(tree.center)
        level = below
    tree.arrays()
    return tree


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... n numbers from each."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def traverse(x: np.ndarray, a: Tree, y: np.ndarray, b: Tree, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of members of the two trees with a cosine of at least ``cosine``: for each member of either, how many
    it has, and (i, j) links that join what the pairs join.

    Node pairs descend together. A pair is dropped if no members can be near enough by the covering radii, and taken
    whole if all must be. ``same``: both are one tree, and a node pair stands for its mirror image."""
    limit = float(_distance(np.float64(cosine)))
    count_a, count_b = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    open_ = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def dots(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ui, at = np.unique(i, return_inverse=True)
        uj, bt = np.unique(j, return_inverse=True)
        if len(ui) * len(uj) < 16 * len(i):
            return (x[ui] @ y[uj].T)[at, bt]
        return np.einsum("ij,ij->i", x[i], y[j])

    def linked(i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(count_a, i, 1)
        np.add.at(count_b, j, 1)
        left.append(i)
        right.append(j)

    while open_:
        p, q = open_.pop()
        if len(p) > PAIRS:
            open_ += [(p[i : i + PAIRS], q[i : i + PAIRS]) for i in range(0, len(p), PAIRS)]
            continue
        d = _distance(dots(a.center[p], b.center[q]))
        reach = a.radius[p] + b.radius[q]
        near = d <= reach + limit + SLACK
        p, q, d, reach = p[near], q[near], d[near], reach[near]
        whole = (d + reach <= limit - SLACK) & ~((p == q) & same)
        whole |= (p == q) & same & (2 * a.radius[p] <= limit - SLACK)
        for i, j in zip(p[whole].tolist(), q[whole].tolist()):
            one, two = a.members[a.low[i] : a.high[i]], b.members[b.low[j] : b.high[j]]
            if same and i == j:
                count_a[one] += len(one) - 1
                left.append(one[1:])
                right.append(np.full(len(one) - 1, one[0]))
            else:
                count_a[one] += len(two)
                count_b[two] += len(one)
                left += [one, np.full(len(two), one[0])]
                right += [np.full(len(one), two[0]), two]
        p, q = p[~whole], q[~whole]
        leaf = (a.first[p] == p) & (b.first[q] == q)
        i, j = p[leaf], q[leaf]
        if len(i):
            m, n = a.high[i] - a.low[i], b.high[j] - b.low[j]
            first = a.members[np.repeat(_spread(a.low[i], m), np.repeat(n, m))]
            second = b.members[_spread(np.repeat(b.low[j], m), np.repeat(n, m))]
            if same:
                keep = (np.repeat(i, m * n) != np.repeat(j, m * n)) | (first < second)
                first, second = first[keep], second[keep]
            good = dots(first, second) >= cosine if len(first) else np.zeros(0, bool)
            linked(first[good], second[good])
        p, q = p[~leaf], q[~leaf]
        if len(p):
            m, n = a.last[p] - a.first[p], b.last[q] - b.first[q]
            first = np.repeat(_spread(a.first[p], m), np.repeat(n, m))
            second = _spread(np.repeat(b.first[q], m), np.repeat(n, m))
            if same:  # of a node with itself, each two children meet once
                keep = (np.repeat(p, m * n) != np.repeat(q, m * n)) | (first <= second)
                first, second = first[keep], second[keep]
            open_.append((first, second))
    if same:
        count_a += count_b
        count_b = count_a
    return count_a, count_b, np.concatenate(left), np.concatenate(right)


def _unit(values: list, dim: int) -> np.ndarray:
    x = np.array(values, dtype=np.float64).reshape(len(values), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """The nearest pivot of each row, and its distance."""
    if not rows.num_rows:
        return pa.table({k.split()[0]: pa.array([], t) for k, t in zip(CELLS.split(", "), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.float64()))})
    values = rows["embedding"].to_pylist()
    dim = len(values[0])
    units = _unit(values, dim)
    order = np.argsort(pivots["pivot"].to_numpy())
    around = _unit([pivots["embedding"][int(i)].as_py() for i in order], dim)
    dots = units @ around.T
    cell = dots.argmax(axis=1)
    return pa.table(
        {
            "label": rows["label"],
            "cell": pa.array(cell.astype(np.int32)),
            "key": rows["key"],
            "unit": pa.array([u.tobytes() for u in units], pa.binary()),
            "far": pa.array(_distance(dots[np.arange(len(cell)), cell])),
        }
    )


def links(nodes: DataFrame, cosine: float) -> DataFrame:
    """key, n, other: for each row that has some, links within one pair of blocks, and another row it is joined to.

    nodes: key, label (a text), embedding, all valid and of equal length within a label."""
    size = stored(nodes.groupBy("label").agg(F.count("*").alias("n")), "labels")
    dealt = size.select(
        "label",
        F.ceil(F.col("n") / DEAL_ROWS).cast("int").alias("salts"),
        F.least(F.lit(PIVOTS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("pivots"),
    )
    rows = nodes.join(dealt, "label")
    pivot = F.pmod(F.xxhash64("key"), F.col("pivots")).cast("int")
    pivots = rows.groupBy("label", pivot.alias("pivot")).agg(F.min_by("embedding", "key").alias("embedding"), F.first("salts").alias("salts"))
    salted = stored(pivots, "pivots").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    cells = stored(
        rows.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.col("salts")).cast("int"))
        .groupBy("label", "salt")
        .cogroup(salted.groupBy("label", "salt"))
        .applyInArrow(_deal, CELLS),
        "cells",
    )
    # A cell is a node of the top level: its pivot is the center, far the covering radius. Large cells are cut.
    top = cells.groupBy("label", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.min_by(F.struct("unit", "far"), F.struct("far", "key")).alias("near")
    )
    top = stored(
        top.select("label", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"), "radius", F.col("near.unit").alias("unit"), F.col("near.far").alias("off")),
        "cell_tops",
    )
    pairs = stored(_near_cells(top, cosine), "cell_pairs")
    blocks = cells.join(top.select("label", "cell", "blocks"), ["label", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")
    )
    sent = (
        blocks.join(pairs, ["label", "cell"])
        .withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        .withColumn("own", F.struct("cell", "block"))
        .withColumn("peer", F.struct(F.col("other").alias("cell"), F.col("other_block").alias("block")))
        .select(
            "label",
            F.least("own", "peer").alias("low"),
            F.greatest("own", "peer").alias("high"),
            (F.col("own") > F.col("peer")).alias("second"),
            "key",
            "unit",
        )
        .select("label", F.to_json("low").alias("low"), F.to_json("high").alias("high"), "second", "key", "unit")
    )

    def meet(rows: pa.Table) -> pa.Table:
        same = rows["low"][0] == rows["high"][0]
        second = rows["second"].to_numpy()
        key = rows["key"].to_numpy()
        units = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(len(key), -1)
        i, j = np.flatnonzero(~second), np.flatnonzero(second)
        n, links = np.zeros(len(key), dtype=np.int64), (np.zeros(0, np.int64),) * 2
        if same:
            tree = build(units)
            n, _, *links = traverse(units, tree, units, tree, True, cosine)
        elif len(i) and len(j):
            n[i], n[j], a, b = traverse(units[i], build(units[i]), units[j], build(units[j]), False, cosine)
            links = i[a], j[b]
        root = union_roots(len(key), *links)
        some = np.flatnonzero(n)
        return pa.table({"key": pa.array(key[some]), "n": pa.array(n[some]), "other": pa.array(key[root[some]])})

    return sent.groupBy("label", "low", "high").applyInArrow(meet, FOUND)


def _near_cells(top: DataFrame, cosine: float) -> DataFrame:
    """label, cell, other, other_blocks: pairs of cells, each in both directions and with itself, of which members can be
    near enough by the radii. One row a cell meets the cells of its label, PIVOTS at most."""
    limit = float(_distance(np.float64(cosine)))

    def work(rows: pa.Table) -> pa.Table:
        units = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(rows.num_rows, -1)
        # unit lies ``off`` from the pivot, so it covers its cell with that much more
        radius = rows["radius"].to_numpy() + rows["off"].to_numpy()
        i, j = np.nonzero(_distance(units @ units.T) <= radius[:, None] + radius[None, :] + limit + SLACK)
        cell, blocks = rows["cell"].to_numpy(), rows["blocks"].to_numpy()
        return pa.table(
            {"label": pa.array([rows["label"][0].as_py()] * len(i), pa.string()), "cell": pa.array(cell[i]), "other": pa.array(cell[j]), "other_blocks": pa.array(blocks[j])}
        )

    return top.groupBy("label").applyInArrow(work, "label string, cell int, other int, other_blocks int")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link if their labels are equal and not null and their cosine is at least ``cosine``; vectors of different
    length do not. A vector that is null, zero, or holds null or non-finite numbers links with nothing, and is its own
    component. Rows that repeat label, vector and id are one vector. component_id is the smallest vec_id of what links
    join; kept is whether that is the row's own. A null vec_id is answered but names no component unless all of its
    component are null. An empty table gives an empty one; other columns are left out.
    """
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    rows = stored(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.xxhash64("vec_id", F.col("label").cast("string"), x).alias("key"),
            sound.alias("sound"),
            F.concat(F.size(x).cast("string"), F.lit(":"), F.col("label").cast("string")).alias("label"),
            x.alias("embedding"),
        ),
        "vectors",
    )
    nodes = rows.filter("sound").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    found = stored(links(nodes, cosine), "vector_links")
    count = found.groupBy("key").agg(F.sum("n").alias("n_links"))
    joined = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    answer = (
        rows.select("vec_id", "key")
        .join(count, "key", "left")
        .join(joined.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    least = answer.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return answer.join(least, "component").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
