"""Embedding near-duplicates by a forest of random-projection trees."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, materialize, table


@dataclass(frozen=True)
class ForestConfig:
    """``fit_rows`` is about the size of the sample of a label, or later of a cell, on which splits are fitted.

    Cells of about ``cell_rows`` rows go to tasks, which split them on to leaves of about
    ``leaf_rows``. A row goes to both sides of a split if it lies within ``reach`` of it. A node
    is split only while that lowers the pairs to compare, so a dense group stays whole. A cell that comes out with
    over four times ``cell_rows`` rows is fitted and split again, on a sample of its own; if no split can
    part it, it is one leaf, and a leaf is compared by pairs of slices of ``slice_rows``. ``deal_rows`` rows
    of a label or cell are dealt by one task.
    """

    threshold: float = 0.93
    trees: int = 4
    fit_rows: int = 20_000
    cell_rows: int = 4096
    leaf_rows: int = 512
    deviations: float = 2.0
    block: int = 1024
    slice_rows: int = 4096
    deal_rows: int = 65_536
    seed: int = 11

    def reach(self, dim: int) -> float:
        """Half of ``deviations`` standard deviations of the projected difference of two vectors
        that are just similar, and no more than half their distance, which parts no pair at all."""
        chord = float(np.sqrt(max(0.0, 2 - 2 * self.threshold)))
        return chord / 2 * min(1.0, self.deviations / np.sqrt(dim))


def directions(config: ForestConfig, tree: int, dim: int, depth: int) -> np.ndarray:
    """One random unit direction per level of a tree, the same wherever it is asked for."""
    r = np.random.default_rng((config.seed, tree, dim)).standard_normal((depth, dim))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def split_at(p: np.ndarray, reach: float) -> tuple[float, float] | None:
    """The band about the median of the projections that spills; None if both sides together
    have no fewer pairs than the node."""
    cut = float(np.median(p))
    low, high = cut - reach, cut + reach
    left, right = int((p <= high).sum()), int((p >= low).sum())
    return (low, high) if left**2 + right**2 < len(p) ** 2 else None


def fit_tree(x: np.ndarray, config: ForestConfig, tree: int, depth: int) -> dict[str, tuple[float, float]]:
    """Bands (low, high) of the upper nodes by path; a path without an entry is a cell."""
    nodes: dict[str, tuple[float, float]] = {}
    if not depth or not len(x):
        return nodes
    p = x @ directions(config, tree, x.shape[1], depth).T
    todo = [("", np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if len(path) >= depth or len(rows) < 32:
            continue
        found = split_at(p[rows, len(path)], config.reach(x.shape[1]))
        if found is None:
            continue
        low, high = found
        nodes[path] = (low, high)
        q = p[rows, len(path)]
        todo += [(path + "0", rows[q <= high]), (path + "1", rows[q >= low])]
    return nodes


def route(x: np.ndarray, nodes: dict[str, tuple[float, float]], config: ForestConfig, tree: int, depth: int) -> list[tuple[str, np.ndarray]]:
    """The cells of a tree and the rows in each; a row in a band goes down both ways."""
    if not nodes:
        return [("", np.arange(len(x)))]
    p = x @ directions(config, tree, x.shape[1], depth).T
    out, todo = [], [("", np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        if path not in nodes:
            out.append((path, rows))
            continue
        low, high = nodes[path]
        q = p[rows, len(path)]
        todo += [(path + "0", rows[q <= high]), (path + "1", rows[q >= low])]
    return [(path, rows) for path, rows in out if len(rows)]


def leaves(x: np.ndarray, config: ForestConfig, seed: tuple[int, ...]) -> list[np.ndarray]:
    """Leaves of one cell: random splits at medians with spill, down to ``leaf_rows`` rows.

    A node that no split of four makes cheaper to compare stays whole.
    """
    rng = np.random.default_rng(seed)
    out, todo = [], [(np.arange(len(x)), 0)]
    while todo:
        rows, tries = todo.pop()
        if len(rows) <= config.leaf_rows:
            out.append(rows)
            continue
        r = rng.standard_normal(x.shape[1])
        q = x[rows] @ (r / np.linalg.norm(r))
        found = split_at(q, config.reach(x.shape[1]))
        if found is None:
            if tries >= 3:
                out.append(rows)
            else:
                todo.append((rows, tries + 1))
            continue
        low, high = found
        todo += [(rows[q <= high], 0), (rows[q >= low], 0)]
    return out


def leaf_pairs(x: np.ndarray, sides: np.ndarray, config: ForestConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with cosine at least the threshold, by blocks, in double precision.

    ``sides`` holds the slice of each row; where a leaf was sliced, only pairs across count.
    """
    crossing = sides.min() != sides.max()
    for a in range(0, len(x), config.block):
        for b in range(a, len(x), config.block):
            i, j = np.nonzero(x[a : a + config.block] @ x[b : b + config.block].T >= config.threshold)
            i, j = i + a, j + b
            keep = i < j
            if crossing:
                keep &= sides[i] != sides[j]
            if keep.any():
                yield i[keep], j[keep]


def link_leaf(x: np.ndarray, sides: np.ndarray, leaf: int, memberships: list[list[int]], copies: np.ndarray, config: ForestConfig) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that this leaf counts, and each row's least index reached in the leaf.

    A pair counts in the smallest leaf that holds both rows, so each counts once though many
    trees find it. Only rows with a pair are looked up.
    """
    n = np.zeros(len(x), np.int64)
    parent = np.arange(len(x))
    for i, j in leaf_pairs(x, sides, config):
        rows = np.unique(np.concatenate((i, j)))
        places: dict[int, int] = {}
        earlier = [[places.setdefault(m, len(places)) for m in memberships[r] if m < leaf] for r in rows.tolist()]
        table_ = np.zeros((len(rows), len(places)), bool)
        for k, own in enumerate(earlier):
            table_[k, own] = True
        table_ = table_[:, table_.sum(axis=0) > 1]
        at_i, at_j = np.searchsorted(rows, i), np.searchsorted(rows, j)
        for c in range(0, len(i), 65_536):
            p, q = at_i[c : c + 65_536], at_j[c : c + 65_536]
            new = ~(table_[p] & table_[q]).any(axis=1)
            one, two = i[c : c + 65_536][new], j[c : c + 65_536][new]
            np.add.at(n, one, copies[two])
            np.add.at(n, two, copies[one])
        while len(i):
            a, b = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
    return n, parent


def embedding_near_dedup(vectors: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels are equal and not null and their vectors' cosine is at least
    the threshold. A label of up to ``trees * cell_rows`` vectors, or one that a tree leaves unsplit, is
    compared as a whole. Otherwise a split parts a linked pair with a probability of at most
    that of ``deviations``, whatever the data, and each tree does so on its own. Vectors that are null, zero, or hold null or non-finite components, and
    those of another length, link with nothing. Equal vectors of a label are first merged to
    one node that carries their number. Each pair is verified exactly and counted once: in the
    first tree, and there the first leaf, in which both rows lie. A leaf gives one row per
    vector with its links and its least neighbour's root, so a group of m near-copies gives
    m rows, not m^2 pairs.

    Null ids keep their row, with no component and no link. Repeated rows count as copies of
    each other: each return the others as links. Ties don't arise: components go by the smallest id. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("embedding", lambda c: c != 0)
    )
    keyed = rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws("|", "label", F.col("embedding").cast("string")), 256)))
    nodes = materialize(
        keyed.where("key is not null")
        .groupBy("key")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")),
        "forest-nodes",
    )
    links = _links(nodes, config)
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(links.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_key = (
        nodes.select("key", "node", "copies")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    out = keyed.select("vec_id", "key").join(per_key, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


CELL = ["label", "dim", "cell"]


def _refined(members: DataFrame, crowded: DataFrame, config: ForestConfig, trees: int) -> DataFrame:
    """``node, label, dim, cell, final`` of the members of crowded cells ``(label, dim, cell, size)``, dealt anew by ``trees`` fitted trees.

    The splits of a cell are one row, which goes to the tasks that deal its members and nowhere
    else. A cell that one of the trees leaves whole keeps its name, once, and is final.
    """
    share = F.pmod(F.xxhash64("node", F.lit(config.seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = members.join(crowded, CELL)
    sample = rows.where(share * F.col("size") < config.fit_rows).select(*CELL, "size", "node", "embedding")

    def fit(key: tuple, group: pa.Table) -> pa.Table:
        label, dim, cell = (k.as_py() for k in key)
        size = group["size"][0].as_py()
        depth = _depth(size, config)
        x = _unit(group.sort_by("node")["embedding"], dim)
        fitted = [fit_tree(x, config, _seed(label, dim, cell, t), depth) for t in range(trees)]
        return pa.table({"label": [label], "dim": pa.array([dim], pa.int32()), "cell": [cell], "size": [size], "fitted": [json.dumps([depth, fitted])]})

    splits = materialize(sample.groupBy(*CELL).applyInArrow(fit, "label string, dim int, cell string, size long, fitted string"), "forest-splits")
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / config.deal_rows)).cast("int")
    left = rows.select(*CELL, F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "node", "embedding")
    right = splits.select(*CELL, "fitted", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))

    def deal(key: tuple, group: pa.Table, split: pa.Table) -> pa.Table:
        label, dim, cell, _ = (k.as_py() for k in key)
        node = group["node"].to_numpy() if len(group) else np.empty(0, np.int64)
        names, chosen, final = [], [], False
        depth, fitted = json.loads(split["fitted"][0].as_py()) if len(split) else (0, [{}])
        if not all(fitted):  # a tree that doesn't split has all pairs in one cell
            names, chosen, final = [cell], [np.arange(len(node))], True
        elif len(node):
            x = _unit(group["embedding"], dim)
            for t, tree in enumerate(fitted):
                for path, rows in route(x, tree, config, _seed(label, dim, cell, t), depth):
                    names.append(f"{cell}/{t}:{path}")
                    chosen.append(rows)
        counts = [len(c) for c in chosen]
        at = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
        return pa.table(
            {
                "node": node[at],
                "label": pa.array([label] * len(at), pa.string()),
                "dim": pa.array([dim] * len(at), pa.int32()),
                "cell": pa.array(np.repeat(np.array(names, object), counts).tolist(), pa.string()),
                "final": pa.array([final] * len(at), pa.bool_()),
            }
        )

    keys = [*CELL, "salt"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(deal, "node long, label string, dim int, cell string, final boolean")


def _links(nodes: DataFrame, config: ForestConfig) -> DataFrame:
    """``node, n, root`` per node and leaf: links counted there and the least node reached."""
    keyed = nodes.select("node", "label", F.size("embedding").alias("dim"), "embedding")
    whole_label = keyed.select("node", "label", "dim", F.lit("").alias("cell"))
    vectors = keyed.select("node", "embedding")
    sizes = lambda of: of.groupBy(*CELL).agg(F.count("*").alias("size"))
    # up to here the cells of all trees have no fewer pairs than the label
    least, most = config.trees * config.cell_rows, 4 * config.cell_rows
    first = materialize(sizes(whole_label), "forest-sizes")
    tables = [first]
    settled = [whole_label.join(first.where(F.col("size").between(2, least)), CELL).select("node", *CELL, "size", F.lit(True).alias("whole"))]
    crowded, members, trees = first.where(F.col("size") > least), keyed.withColumn("cell", F.lit("")), config.trees
    while not crowded.isEmpty():
        dealt = materialize(_refined(members, crowded, config, trees), "forest-cells")
        sized = materialize(sizes(dealt), "forest-sizes")
        tables += [dealt, sized]
        joined = dealt.join(sized.where("size > 1"), CELL)
        settled.append(joined.where(F.col("final") | (F.col("size") <= most)).select("node", *CELL, "size", F.col("final").alias("whole")))
        again = joined.where(~F.col("final") & (F.col("size") > most))
        crowded = again.select(*CELL, "size").distinct()
        members, trees = again.select("node", *CELL).join(vectors, "node"), 1
    in_cells = reduce(DataFrame.unionByName, settled)

    def divide(key: tuple, group: pa.Table) -> pa.Table:
        label, dim, name = (k.as_py() for k in key)
        group = group.sort_by("node")
        node = group["node"].to_numpy()
        seed = zlib.crc32(f"{config.seed}|{label}|{dim}|{name}".encode())
        out_node, out_leaf = [], []
        for k, rows in enumerate(leaves(_unit(group["embedding"], dim), config, (seed,))):
            out_node.append(node[rows])
            out_leaf.append(np.full(len(rows), xxhash.xxh64_intdigest(f"{label}|{dim}|{name}|{k}") >> 1, np.int64))
        return pa.table({"node": np.concatenate(out_node), "leaf": np.concatenate(out_leaf)})

    whole = in_cells.where("whole").select("node", F.shiftrightunsigned(F.xxhash64(*CELL), 1).alias("leaf"))
    split = in_cells.where("not whole").select("node", *CELL).join(vectors, "node").groupBy(*CELL).applyInArrow(divide, "node long, leaf long")
    members = materialize(whole.union(split), "forest-leaves")
    discard(*tables)
    leaf_sizes = members.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
    slices = F.ceil(F.col("size") / config.slice_rows).cast("int")
    placed = members.join(leaf_sizes, "leaf").select("leaf", "node", slices.alias("slices"), F.pmod(F.xxhash64("node"), slices).cast("int").alias("side"))
    per_node = members.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    full = nodes.select("node", "copies", "embedding").join(per_node, "node")
    tasks = (
        placed.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
        .select("leaf", "node", "side", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"))
        .join(full, "node")
    )

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        group = group.sort_by("node")
        node = group["node"].to_numpy()
        x = _unit(group["embedding"], len(group["embedding"][0].as_py()))
        n, least = link_leaf(x, group["side"].to_numpy(), leaf, group["leaves"].to_pylist(), group["copies"].to_numpy(), config)
        keep = (n > 0) | (least != np.arange(len(n)))
        return pa.table({"node": node[keep], "n": n[keep], "root": node[least][keep]})

    links = materialize(tasks.groupBy("leaf", "first", "second").applyInArrow(compare, "node long, n long, root long"), "forest-links")
    discard(members)
    return links


def _seed(label: str, dim: int, cell: str, tree: int) -> int:
    return zlib.crc32(f"{label}|{dim}|{cell}|{tree}".encode())


def _depth(size: int, config: ForestConfig) -> int:
    """Levels to cells of ``cell_rows`` rows, if a side with its spill has two thirds of a node."""
    return max(0, int(np.ceil(np.log(size / config.cell_rows) / np.log(1.5))))


def _unit(embedding: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = embedding.combine_chunks() if isinstance(embedding, pa.ChunkedArray) else embedding
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))
