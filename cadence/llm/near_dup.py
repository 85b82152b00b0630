"""MinHash near-duplicate components through an LSH forest.

Documents with equal shingle sets form a class, which is compared once. Each class has a MinHash signature; each tree
of the forest sorts signatures by its own order of the values. Classes whose first `DEPTH` values agree in a tree are a
region. In a small region all members are candidates of one another (the bound makes that a fixed number each); in a
larger one, candidates are the nearest in sorted order, those with the longest common prefixes. Candidates chain to groups; in each group, the members that agree
best with the most frequent value at each place of the signature (the text that copies were made from) are its hubs.

Links are confirmed on full shingle sets: first every member against its hub, then members that this left out against
further hubs, in rounds, and, last, every candidate pair whose ends are not yet together. What these links bring together
goes by one name. In each larger region, strays, the members of all names but the most frequent, are held against the
members of other names whose signatures agree well enough. So a large group of near copies costs a number of comparisons
in proportion to its size.

At a similarity of 0.75 a pair shares a region in one of 24 trees with probability 1 - (1 - 0.75^4)^24 > 0.9998.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.session import written

TREES, DEPTH, DEEPER = 24, 4, 8
VALUES = TREES * DEPTH
SMALL = 32
NEIGHBOURS = 3
HUBS = 4
CONSENSUS = 48
HUB_ROUNDS = 4
#: Members of larger regions that no hub took, up to which no further hubs are looked for.
FEW = 64
BLOCK = 256
#: Rows of either side of a large region that one task holds against one another.
REGION_ROWS = 4096
#: Share of agreeing values below which a pair is no candidate; 0.75 lies four standard deviations above.
LEAST_ALIKE = 0.57
#: Contracted graphs of at most so many edges, a fixed number, are finished by one task.
FINISH_EDGES = 20_000
BROADCAST_ROWS = 200_000
#: Pairs of one hub that one task compares.
HUB_PAIRS = 256

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(1905)
_A = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = value
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of n-word shingles; the whole text as one if it has fewer words; none: empty."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = h[: len(words) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : len(words) - width + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES minima of random linear functions of the hashes' upper halves."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as little-endian bytes."""
    return hashes.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _print(hashes: np.ndarray) -> bytes | None:
    """128-bit fingerprint of a set; none for the empty one."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, print, sig) of (doc_id, key, text): set size, fingerprint of the set and signature."""

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n, prints, sigs = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    n.append(len(s))
                    prints.append(_print(s))
                    sigs.append(signature(s).tobytes() if len(s) else None)
                columns = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "print", "sig"])

    return docs.select("doc_id", "key", "text").mapInArrow(sign, "doc_id long, key long, n long, print binary, sig binary")


def _tree_rows(classes: DataFrame, deep: bool = False) -> DataFrame:
    """(key, node) of a class's place in each tree: the key hashes the tree and its first values. With `deep`, also the
    values that follow, as bytes in sorting order, and the tree's number."""

    def place(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                nodes = batch.column(0)[at : at + 2048].to_numpy()
                sigs = np.frombuffer(b"".join(batch.column(1)[at : at + 2048].to_pylist()), "<u4").reshape(-1, VALUES)
                for t in range(TREES):
                    order = np.roll(np.arange(VALUES), -t * DEPTH)[: DEPTH + DEEPER]
                    rows = np.ascontiguousarray(sigs[:, order]).astype(">u4")
                    keys = [xxhash.xxh3_64_intdigest(r[:DEPTH].tobytes(), seed=t) - (1 << 63) for r in rows]
                    columns = [pa.array(keys, pa.int64()), pa.array(nodes)]
                    if deep:
                        columns += [pa.array([r[DEPTH:].tobytes() for r in rows], pa.binary()), pa.array([t] * len(keys), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "node", "deep", "tree"][: len(columns)])

    return classes.select("node", "sig").mapInArrow(place, "key long, node long" + ", deep binary, tree long" * deep)


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b), a < b, of classes; and the members (region, tree, node, deep) of larger regions."""
    regions = written(_tree_rows(classes).select("key").groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "regions")
    members = written(_tree_rows(classes).join(regions.hint("merge"), "key"), "members")
    small = members.where(F.col("size") <= SMALL).select("key", "node")
    all_pairs = small.join(small.select("key", F.col("node").alias("b")), "key").where("node < b").select(F.col("node").alias("a"), "b")
    # only classes of larger regions need the values that follow
    crowded = members.where(F.col("size") > SMALL).select("node").distinct()
    large = _tree_rows(classes.join(crowded, "node", "left_semi"), deep=True).join(regions.where(F.col("size") > SMALL), "key")
    large = written(large.select(F.col("key").alias("region"), "tree", "node", "deep"), "crowded")
    pairs = all_pairs if large.isEmpty() else all_pairs.unionByName(_next_to(large))
    return written(pairs.distinct(), "pairs"), large


def _next_to(large: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of members that are at most NEIGHBOURS apart in their region's order.

    Regions lie in ranges of the order of all of them, so a large one is spread over many; what is next to one another
    across the end of a range is found among the first and last rows of the ranges.
    """

    def lead(batches):
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), 0
        last: list[tuple[int, int]] = []
        for batch in batches:
            now = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            joined = last + now
            out = [(r, x, y, None) for k in range(1, NEIGHBOURS + 1) for (q, x), (r, y) in zip(joined, joined[k:], strict=False) if q == r and x != y]
            out += [(r, x, None, part * 2) for r, x in now[: max(0, NEIGHBOURS - rows)]]
            rows += len(now)
            last = joined[-NEIGHBOURS:]
            yield as_batch(out)
        yield as_batch([(r, x, None, part * 2 + 1) for r, x in last])

    def as_batch(out):
        kinds = [pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["region", "a", "b", "end"])

    order = ["region", "deep", "node"]
    near = large.repartitionByRange(*order).sortWithinPartitions(*order).select("region", "node").mapInArrow(lead, "region long, a long, b long, end long")
    near = written(near, "near")
    ends = near.where("b IS NULL").select("region", "a", "end")
    firsts = ends.where("end % 2 = 0").select("region", (F.col("end") - 1).alias("end"), F.col("a").alias("b"))
    across = ends.where("end % 2 = 1").join(firsts, ["region", "end"]).where("a <> b").select("a", "b")
    pairs = near.where("b IS NOT NULL").select("a", "b").unionByName(across)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _strays(crowded: DataFrame, names: DataFrame) -> DataFrame:
    """(region, tree, node, stray) of the larger regions that hold several names; all but the most frequent are strays."""
    rows = crowded.select("region", "tree", "node").join(names.select(F.col("n").alias("node"), "name"), "node", "left").withColumn("name", F.coalesce("name", "node"))
    rows = written(rows, "region_names")
    main = rows.groupBy("region", "name").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("name", F.struct("k", "name")).alias("main"), F.count("*").alias("several"))
    return rows.join(main.where("several > 1"), "region").select("region", "tree", "node", (F.col("name") != F.col("main")).alias("stray"))


def _stray_links(members: DataFrame, names: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), a < b, of the strays among members (region, tree, node, stray) with members of another name.

    Strays and members meet as blocks of BLOCK signatures and sets. Within a task a pair is compared if this is the first
    tree that it shares a region in, at least LEAST_ALIKE of the signatures' values agree, and then on its full sets; what
    leaves the task is links. Blocks of large regions meet in the cells of a grid, so every pair of blocks meets once, and
    a task has at most REGION_ROWS strays and members or so of a region.
    """
    sizes = members.groupBy("region").agg(F.sum(F.col("stray").cast("long")).alias("n"), F.count("*").alias("m")).where("n > 0")
    rows = written(members.join(written(sizes, "stray_regions"), "region"), "met")
    info = classes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "sig").join(sets, "node")
    info = info.join(names.select(F.col("n").alias("node"), "name"), "node", "left").select("node", "sig", "set", F.coalesce("name", "node").alias("name"))
    info = written(info, "info")

    def blocks(rows: DataFrame, own: str, other: str, items: str, cells: tuple[str, str]) -> DataFrame:
        side = max(1, REGION_ROWS // BLOCK)
        count = lambda c: F.ceil(F.col(c) / F.lit(BLOCK))
        grid = lambda c: F.ceil(count(c) / F.lit(side))
        block = F.pmod(F.xxhash64("node"), count(own))
        listed = F.collect_list(F.struct("node", "name", "stray", "sig", "set"))
        rows = rows.join(info, "node").groupBy("region", "tree", own, other, block.alias("block")).agg(listed.alias(items))
        rows = rows.withColumn(cells[0], F.pmod(F.col("block"), grid(own)))
        return rows.select("region", "tree", items, cells[0], F.explode(F.sequence(F.lit(0).cast("long"), grid(other) - 1)).alias(cells[1]))

    def side(column):
        import pyarrow.compute as pc

        flat = column.flatten()
        node, name, stray = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        return node, name, stray, np.frombuffer(b"".join(flat.field(3).to_pylist()), "<u4").reshape(-1, VALUES), flat.field(4), pc.binary_length(flat.field(4)).to_numpy().astype("i8")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tree = batch.column(0)[i].as_py()
                x, x_name, _, x_sig, x_set, x_size = side(batch.column(1).slice(i, 1))
                y, y_name, y_stray, y_sig, y_set, y_size = side(batch.column(2).slice(i, 1))
                y_sets: dict[int, np.ndarray] = {}
                found = set()
                for k in range(len(x)):
                    # two strays meet twice
                    may = (y_name != x_name[k]) & (~y_stray | (y > x[k])) & (np.minimum(y_size, x_size[k]) * 100 >= percent * np.maximum(y_size, x_size[k]))
                    may = np.flatnonzero(may)
                    same = y_sig[may] == x_sig[k]
                    # in eights of bytes, as no byte's sum passes VALUES / 8
                    agree = same.view("u8").sum(axis=1).view("u1").reshape(-1, 8).sum(axis=1)
                    near = np.flatnonzero(agree >= LEAST_ALIKE * VALUES)
                    at = may[near[same[near].reshape(-1, TREES, DEPTH).all(axis=2).argmax(axis=1) == tree]].tolist()
                    own = unpack(x_set[k].as_py()) if at else None
                    for j in at:
                        if j not in y_sets:
                            y_sets[j] = unpack(y_set[j].as_py())
                        if linked(own, y_sets[j], percent):
                            found.add((min(x[k], y[j]), max(x[k], y[j])))
                pairs = np.array(sorted(found), "i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    left, right = blocks(rows.where("stray"), "n", "m", "strays", ("u", "v")), blocks(rows, "m", "n", "members", ("v", "u")).drop("tree")
    met = left.join(right, ["region", "u", "v"]).select("tree", "strays", "members")
    return written(met.mapInArrow(compare, "a long, b long").distinct(), "stray_links")


def _union_find(edges_a: np.ndarray, edges_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of some edges; the root is a component's smallest node."""
    nodes, index = np.unique(np.concatenate([edges_a, edges_b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(index[: len(edges_a)].tolist(), index[len(edges_a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def _local(edges: DataFrame, keep_roots: bool) -> DataFrame:
    """Each partition's edges (a, b) replaced by those from each node to its root within the partition."""

    def reduce(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            nodes, roots = _union_find(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            use = np.ones(len(nodes), bool) if keep_roots else nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(roots[use])], ["a", "b"])

    return edges.select("a", "b").mapInArrow(reduce, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): nodes of a component, and no others, share a root.

    Rounds of contraction: each node takes the name of a neighbour of lower hash, two steps on; what is left of the
    edges between different names goes to the next round, until a fixed small number is left for one task.
    """
    edges = written(_local(edges, False), "edges")
    labels = None
    while (n := edges.count()) > 0:
        if n <= FINISH_EDGES:
            step = _local(edges.coalesce(1), True).select(F.col("a").alias("x"), F.col("b").alias("y"))
        else:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rank = lambda c: F.xxhash64(F.lit(n), c)
            low = F.min(F.struct(rank(F.col("b")).alias("r"), "b"))
            parent = both.groupBy("a").agg(low.alias("low")).select("a", F.when(F.col("low.r") < rank(F.col("a")), F.col("low.b")).otherwise(F.col("a")).alias("p"))
            parent = written(parent, "parent")
            step = parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select(F.col("a").alias("x"), F.col("q").alias("y"))
        step = written(step, "step")
        if labels is None:
            labels = step.select(F.col("x").alias("node"), F.col("y").alias("root"))
        else:
            old = labels.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"))
            new = step.join(labels, F.col("x") == F.col("node"), "left_anti").select(F.col("x").alias("node"), F.col("y").alias("root"))
            labels = written(old.unionByName(new), "labels")
        if n <= FINISH_EDGES:
            break
        renamed = edges.join(step.select(F.col("x").alias("a"), F.col("y").alias("ra")), "a").join(step.select(F.col("x").alias("b"), F.col("y").alias("rb")), "b")
        edges = written(_local(renamed.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), False), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _hubs(grouped: DataFrame, classes: DataFrame) -> DataFrame:
    """(root, place, hub): the HUBS members of each group (node, root) that agree best with its most frequent values."""

    def values(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sigs = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(-1, VALUES)[:, :CONSENSUS]
                k = len(sigs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), CONSENSUS)), pa.array(np.repeat(part.column(1).to_numpy(), CONSENSUS)),
                     pa.array(np.tile(np.arange(CONSENSUS), k)), pa.array(sigs.ravel().astype("i8"))], ["root", "node", "place", "value"]
                )

    rows = grouped.join(classes.select("node", "sig"), "node").select("root", "node", "sig").mapInArrow(values, "root long, node long, place long, value long")
    rows = written(rows, "values")
    modes = rows.groupBy("root", "place", "value").agg(F.count("*").alias("n")).groupBy("root", "place").agg(F.max_by("value", F.struct("n", "value")).alias("mode"))
    agree = (
        rows.join(written(modes, "modes"), ["root", "place"])
        .groupBy("root", "node")
        .agg(F.sum((F.col("value") == F.col("mode")).cast("int")).alias("agree"))
    )
    best = Window.partitionBy("root", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(F.desc("agree"), "node")
    some = agree.withColumn("k", F.row_number().over(best)).where(F.col("k") <= HUBS).drop("k")
    # lists are merged before they are dealt by root, so a root's task reads a row a bucket at most
    ranked = some.groupBy("root").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("agree")).alias("order"), "node"))), 1, HUBS).alias("h"))
    return ranked.select("root", F.posexplode("h").alias("k", "h")).select("root", (F.col("k") + 1).alias("place"), F.col("h.node").alias("hub"))


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set) of the classes among `nodes`, from the text of a class's first document."""
    side = classes.join(nodes.select("node").distinct(), "node", "left_semi").select("node", F.col("head.doc_id").alias("first_id"), "print")
    side = written(side, "nodes")
    wanted = side.count()
    side = F.broadcast(side) if wanted <= BROADCAST_ROWS else side

    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                # another document of that id has another set
                own = pa.array([_print(s) == p for s, p in zip(sets, part.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(pack, sets), pa.binary())], ["node", "set"]).filter(own)

    picked = docs.join(side, F.col("doc_id") == F.col("first_id")).select("node", "print", "text")
    sets = written(picked.mapInArrow(build, "node long, set binary"), "sets")
    return sets if sets.count() == wanted else written(sets.dropDuplicates(["node"]), "sets")  # repeated rows


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; `a` should be the side with fewer different values.

    A value of `a` in more than HUB_PAIRS pairs has a copy of its set for every HUB_PAIRS of them, so its pairs are
    spread over tasks.
    """

    def check(batches):
        for batch in batches:
            a, b, ok = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                ok.append(linked(unpack(x.as_py()), unpack(y.as_py()), percent))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_PAIRS)).alias("k")), "hub_pairs")
    copies = sets.join(hubs.withColumnRenamed("a", "node"), "node").select(
        F.col("node").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"), F.col("set").alias("sa")
    )
    busy = hubs.where("k > 1")
    busy = F.broadcast(busy) if busy.count() <= BROADCAST_ROWS else busy
    salted = pairs.join(busy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1).cast("long"))).alias("salt"))
    right = sets.join(pairs.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("b"), F.col("set").alias("sb"))
    rows = salted.join(right.hint("merge"), "b").join(copies.hint("merge"), ["a", "salt"]).select("a", "b", "sa", "sb")
    return written(rows.mapInArrow(check, "a long, b long").distinct(), "confirmed")


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes that hold their components together, from candidate pairs and members of larger regions."""
    groups = components(pairs)
    sets = _sets(docs, classes, groups)
    found, open_pairs, left = None, pairs, groups
    for _ in range(HUB_ROUNDS):
        hubs = written(_hubs(left, classes), "hubs")
        first = hubs.where("place = 1").select("root", F.col("hub").alias("a"))
        stars = left.join(first, "root").where("node <> a").select("a", F.col("node").alias("b"))
        new = _confirmed(stars, sets, percent)
        taken = new.select(F.col("b").alias("node")).unionByName(first.select(F.col("a").alias("node")))
        rest = left.join(taken, "node", "left_anti")
        others = rest.join(hubs.where("place > 1").select("root", F.col("hub").alias("a")), "root").where("node <> a")
        others = _confirmed(others.select("a", F.col("node").alias("b")), sets, percent)
        both = new.unionByName(others)
        found = both if found is None else found.unionByName(both)
        # members of larger regions that no hub has taken: they may be a family of their own, with its own hub
        rest = rest.join(others.select(F.col("b").alias("node")), "node", "left_anti").select("node")
        rest = written(rest.join(crowded.select("node"), "node", "left_semi"), "rest")
        if rest.count() <= FEW or both.isEmpty():
            break
        open_pairs = open_pairs.join(rest.select(F.col("node").alias("a")), "a", "left_semi").join(rest.select(F.col("node").alias("b")), "b", "left_semi")
        open_pairs = written(open_pairs, "open")
        left = components(open_pairs)
    names = written(components(found).select(F.col("node").alias("n"), F.col("root").alias("name")), "names")
    named = (
        pairs.join(names.select(F.col("n").alias("a"), F.col("name").alias("na")), "a", "left")
        .join(names.select(F.col("n").alias("b"), F.col("name").alias("nb")), "b", "left")
        .where(F.coalesce("na", "a") != F.coalesce("nb", "b"))
        .select("a", "b")
    )
    found = found.unionByName(_confirmed(written(named, "open"), sets, percent))
    return found if crowded.isEmpty() else found.unionByName(_stray_links(_strays(crowded, names), names, classes, sets, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, row_keys: bool = False) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept; with `row_keys` also row_key and first.

    Words are runs of anything but ASCII white space, A-Z in lower case; shingles are 5 words (all words, if fewer).
    Two documents are linked if 100 * |common shingles| >= percent * |all their shingles|. component_id is the smallest
    id that links reach; kept says whether that is the document's own.

    row_key is xxhash64 of the id and the text. first is true for the component's smallest (id, row_key), so of a
    component one row is first, but for rows that are alike in id and text, which all are.

    Null texts and texts without words have no shingles and no links. Rows with a null id are linked with nothing, have
    a null component_id and are kept. Rows that share an id are each judged by their text. An empty table gives an
    empty result. Further columns are not read. Sets are compared by 64-bit hashes of shingles.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    signed = written(_sign(docs), "signed")
    usable = signed.where("print IS NOT NULL AND doc_id IS NOT NULL")
    classes = usable.groupBy("print").agg(F.min(F.struct("doc_id", "key")).alias("head"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    # written once, so a class keeps its number
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs, crowded = _candidates(classes)
    if pairs.isEmpty():
        linked_nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        linked_nodes = components(_links(docs, classes, pairs, crowded, percent))
    member = classes.select("print", "head", "node", "copies").join(linked_nodes, "node", "left").where("copies > 1 OR root IS NOT NULL")
    member = written(member.select("print", "head", F.coalesce("root", "node").alias("root")), "member")
    smallest = member.groupBy("root").agg(F.min("head").alias("component"))
    final = written(member.join(smallest, "root").select("print", "component"), "final")
    out = signed.select("doc_id", "key", "n", "print").join(final, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component.doc_id", "doc_id"))
    more = [F.col("key").alias("row_key"), (F.col("component").isNull() | F.col("doc_id").isNull() | (F.struct("doc_id", "key") == F.col("component"))).alias("first")] if row_keys else []
    return out.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *more,
    )
