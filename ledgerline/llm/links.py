"""Connected components, and Jaccard links within groups by signature trees.

``components`` is a distributed union-find. ``set_links`` finds, for groups of sets, which pairs reach a Jaccard similarity: a group's sets lie in
units of bounded size, each unit has a signature tree, trees are joined by dual traversal, and the pairs of leaves that are left are compared exactly.
``sketch_links`` and ``close_links`` do the same on the bitmaps alone, which are a fiftieth of a text.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SLICE, Forest, least_labels, mix, raw, release, shared
from .tables import Tables

EDGES_A_TASK = 1_000_000
FINISH = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of a partition, block by block: each node with the least node of its component."""
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        a = np.concatenate((a, batch.column("a").to_numpy()))
        b = np.concatenate((b, batch.column("b").to_numpy()))
        if len(a) > 4 * EDGES_A_TASK:
            a, b = least_labels(a, b)
            a, b = a[a != b], b[a != b]
    nodes, label = least_labels(a, b)
    apart = nodes != label
    yield pa.record_batch([pa.array(nodes[apart]), pa.array(label[apart])], names=["a", "b"])


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, label (the least node of the component) of every node that the edges (a, b: long) name.

    Partitions first replace their edges by spanning forests, without a shuffle. Then alternating star rounds run until nothing changes: each
    node's neighbours are hung on the least of them, first the larger ones, then the smaller ones. Minima are combined before the shuffle; the
    joins have both sides shuffled by the join itself, so that a hub with a large share of all edges is split at run time. Every round is a
    written table: a lost executor costs a round at most. Up to ``FINISH`` edges, counted beforehand, are finished in one task instead (16 bytes each).
    """
    edges = tables.save(
        edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    if edges.count() <= FINISH:
        edges = tables.save(edges.repartition(1).mapInArrow(_forest, "a long, b long"), f"{name}-whole")
        settled = True
    else:
        settled = False
    for k in itertools.count(1):
        if settled:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-{k}-least")
        # large star: a node's larger neighbours, and itself, go to the least of its neighbourhood
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = least.filter("a <> m").select("a", F.col("m").alias("b"))
        larger = tables.save(large.unionByName(own).filter("a <> b").distinct(), f"{name}-{k}-large")
        # small star: all smaller neighbours of a node go to the least of them
        low = tables.save(larger.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}-low")
        small = larger.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = tables.save(new, f"{name}-{k}")
        settled = _same(edges, new)
        tables.drop(f"{name}-{k}-least", f"{name}-{k}-large", f"{name}-{k}-low", f"{name}-{k - 1}")
        tables.free()
        edges = new
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets of edges are the same, by their number and a sum of hashes."""
    sums = [df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for df in (a, b)]
    return tuple(sums[0]) == tuple(sums[1])


#: Of one unit, and of one task's pair of units twice this.
UNIT_SETS, UNIT_VALUES = 512, 2_000_000
#: The same for units of sketches.
SKETCH_SETS, SKETCH_VALUES = 2048, 16_000_000
FAN = 8
#: Bits that the smallest sketch has.
LEAST_BITS = 64
#: Words of bitmaps that one step of a traversal holds of each side, about 4 MB.
WORDS = 1 << 19


def sketch(values: np.ndarray) -> bytes:
    """A set's size and token bitmap: a bit is set if a value falls on it. It has one or two bits a value. One of twice the bits becomes one of half by OR of its halves."""
    bits = max(LEAST_BITS, 1 << max(0, len(values) - 1).bit_length())
    slot = ((values >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return len(values).to_bytes(8, "little") + np.packbits(np.bincount(slot, minlength=bits) > 0, bitorder="little").tobytes()


def _sketches(data: list[bytes]) -> list[np.ndarray]:
    """The sketches as words; the first word is the size."""
    return [np.frombuffer(x, dtype=np.uint64) for x in data]


def _need(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes that reaches the similarity: 100 i >= p (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


class SignatureForest:
    """Many signature trees side by side. Leaves are sets, in order of tree and size; a node of up to ``FAN`` children of one tree holds the OR and the AND of their
    bitmaps and their range of sizes. On the last level every tree has one node, its root; node numbers there are tree numbers."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, tree: np.ndarray):
        self.levels = [(maps, maps, sizes, sizes)]
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            first = np.flatnonzero(np.diff(tree, prepend=-1))
            inside = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            if self.children and not inside.any():
                break
            starts = np.flatnonzero(inside % FAN == 0)
            any_, all_, low, high = self.levels[-1]
            ufuncs = ((np.bitwise_or, any_), (np.bitwise_and, all_), (np.minimum, low), (np.maximum, high))
            self.levels.append(tuple(f.reduceat(x, starts, axis=0) for f, x in ufuncs))
            self.children.append((starts, np.diff(np.append(starts, len(tree)))))
            tree = tree[starts]

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a pair of sets that is similar enough, by their sizes and by the largest overlap.

        A bit that all sets of one node have and no set of the other one stands for a value that no overlap has.
        """
        any_, all_, low, high = self.levels[level]
        keep = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        at = np.flatnonzero(keep)
        a, b = i[at], j[at]
        most = np.minimum(
            high[a] - np.bitwise_count(all_[a] & ~any_[b]).sum(axis=1, dtype=np.int64), high[b] - np.bitwise_count(all_[b] & ~any_[a]).sum(axis=1, dtype=np.int64)
        )
        keep[at] = most >= _need(low[a], low[b], percent)
        return keep

    def traverse(self, i: np.ndarray, j: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that no bound excludes, below the pairs (i, j) of roots; within one tree each pair once. Depth first, in blocks of bounded size."""
        rows = max(1, WORDS // self.levels[0][0].shape[1])
        todo = [(len(self.levels) - 1, i, j)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > rows:
                todo += [(level, i[rows:], j[rows:]), (level, i[:rows], j[:rows])]
                continue
            keep = self.possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            part = max(1, rows // (FAN * FAN))
            todo += [(level - 1, *self._below(level - 1, i[at : at + part], j[at : at + part])) for at in range(0, len(i), part)]

    def _below(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a child of i with a child of j; of a node with itself each pair once, and on the level of sets none of a set with itself."""
        starts, counts = self.children[level]
        pairs = counts[i] * counts[j]
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        width = np.repeat(counts[j], pairs)
        left, right = np.repeat(starts[i], pairs) + k // width, np.repeat(starts[j], pairs) + k % width
        once = np.repeat(i != j, pairs) | ((left < right) if level == 0 else (left <= right))
        return left[once], right[once]


def candidates(sketches: list[np.ndarray], unit: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of one unit (of both its sides, where it has two) that signature trees can't exclude, a block at a time.

    Trees are joined in the width of the narrower bitmap: sets with bitmaps of one width, and those with the next one, which are folded.
    """
    size = np.array([int(s[0]) for s in sketches], dtype=np.int64)
    width = np.array([len(s) - 1 for s in sketches])
    two = np.zeros(int(unit.max(initial=0)) + 1, dtype=bool)
    two[unit[side == 1]] = True
    for words in np.unique(width).tolist():
        own = np.flatnonzero((width == words) | ((width == 2 * words) & (percent * size <= 100 * 64 * words)))
        wide = (width[own] != words).astype(np.int64)
        key = unit[own] * 4 + side[own] * 2 + wide
        order = np.lexsort((size[own], key))
        own, key = own[order], key[order]
        maps = np.stack([_folded(sketches[k][1:], words) for k in own.tolist()])
        names, tree = np.unique(key, return_inverse=True)
        forest = SignatureForest(maps, size[own], tree)
        roots = []
        for a, b, which in ((0, 0, ~two), (0, 1, ~two), (0, 2, two), (0, 3, two), (1, 2, two)):  # as 2 side + wide
            left = names[(names % 4 == a) & which[names // 4]]
            left = left[np.isin(left - a + b, names)]
            roots.append((np.searchsorted(names, left), np.searchsorted(names, left - a + b)))
        i, j = (np.concatenate([r[k] for r in roots]) for k in (0, 1))
        for x, y in forest.traverse(i, j, percent):
            yield own[x], own[y]


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    return words if len(words) == to else words[:to] | words[to:]


def _set_links(ids: np.ndarray, unit: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of units: what the trees leave is compared exactly, unless it is known to be connected."""
    _, known = np.unique(label, return_inverse=True)
    forest, a, b = Forest(len(known)), [], []
    for x, y in candidates(_sketches([sketch(s) for s in sets]), unit, side, percent):
        apart = known[x] != known[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            p, q = int(known[i]), int(known[j])
            if forest.find(p) != forest.find(q):
                common = shared(sets[i], sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    forest.join(p, q)
                    a.append(i)
                    b.append(j)
    return ids[np.array(a, dtype=np.int64)], ids[np.array(b, dtype=np.int64)]


def _sketch_links(ids: np.ndarray, unit: np.ndarray, side: np.ndarray, label: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that the trees leave; all that is known to be connected is passed over."""
    a = b = np.zeros(0, dtype=np.int64)
    mixed = np.zeros(int(unit.max(initial=0)) + 1, dtype=bool)  # units of several labels
    first = np.flatnonzero(np.diff(unit, prepend=-1))
    if len(first):
        mixed[unit[first]] = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    own = np.flatnonzero(mixed[unit])
    if not len(own):
        return a, b
    for x, y in candidates([sets[k] for k in own.tolist()], unit[own], side[own], percent):
        x, y = label[own[x]], label[own[y]]
        apart = x != y
        a, b = np.concatenate((a, x[apart])), np.concatenate((b, y[apart]))
        if len(a) > 1 << 18:
            a, b = least_labels(a, b)
            a, b = a[a != b], b[a != b]
    a, b = least_labels(a, b)
    return a[a != b], b[a != b]


def _join_units(percent: int, expand: Callable[[list[bytes]], list[np.ndarray]], links_of: Callable) -> Callable:
    """For one task, whose rows are sorted by unit: the links of its units, some units at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_units(batches):
            if rows.num_rows > 1:
                _, unit = np.unique(rows.column("unit").to_numpy(), return_inverse=True)
                ids, side, label = (rows.column(c).to_numpy() for c in ("id", "side", "label"))
                links = links_of(ids, unit, side, label, _expanded(raw(rows.column("data")), expand), percent)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
        release()

    return run


def _expanded(data: list[bytes], expand: Callable[[list[bytes]], list[np.ndarray]]) -> list[np.ndarray]:
    """The sets of all data, made from about a slice of it at a time."""
    out: list[np.ndarray] = []
    begin = size = 0
    for i, x in enumerate(data):
        if size and size + len(x) > SLICE:
            out += expand(data[begin:i])
            begin, size = i, 0
        size += len(x)
    return out + expand(data[begin:]) if begin < len(data) else out


def _whole_units(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21) -> Iterator[pa.Table]:
    """Sorted rows again, in runs that hold whole units and about ``limit`` bytes of data, or one larger unit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        lengths = np.cumsum(pc.binary_length(batch.column("data")).to_numpy())
        starts = np.concatenate(([0], np.flatnonzero(np.diff(unit)) + 1)).tolist() if len(unit) else []
        last = held[-1].column("unit")[-1].as_py() if held else None
        begin = 0
        for at in starts:
            fresh = at > 0 or unit[0] != last
            here = int(lengths[at - 1]) - (int(lengths[begin - 1]) if begin else 0) if at else 0
            if fresh and (held or at > begin) and size + here > limit:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, at
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
            size += int(lengths[-1]) - (int(lengths[begin - 1]) if begin else 0)
    if held:
        yield pa.Table.from_batches(held)


def _linked(rows: DataFrame, join: Callable) -> DataFrame:
    """Links of rows (unit, side, id, label, data), whose units meet in one task each, sorted."""
    own = rows.select(F.xxhash64("unit").alias("unit"), "side", "id", "label", "data")
    return own.repartition("unit").sortWithinPartitions("unit").mapInArrow(join, "a long, b long")


def sketch_links(sizes: DataFrame, sketches: DataFrame, percent: int, tables: Tables, name: str, known: DataFrame | None = None) -> DataFrame:
    """node, label of all sets that have a partner in a partition which signature trees over sketches (id, data) can't exclude: no link lies outside these components."""
    units = (SKETCH_SETS, SKETCH_VALUES)
    return _group_links(sizes, lambda ids: sketches, _join_units(percent, _sketches, _sketch_links), percent, units, tables, name, known)


def close_links(members: DataFrame, percent: int, tables: Tables, name: str) -> DataFrame:
    """node, label of sets (group, id, n, data) that trees over sketches connect within units of a group; a set may be in several groups.

    No pair of units is joined, so this costs no more than the rows that come in, and connects most of what is near, not all.
    """
    whole = members.groupBy("group").agg(F.count("*").alias("sets")).filter("sets > 1")
    deals = F.ceil(F.col("sets") / SKETCH_SETS)
    unit = F.struct("group", F.pmod(F.xxhash64("id", "group"), deals).alias("deal")).alias("unit")
    rows = members.join(whole, "group").select(unit, F.lit(0).alias("side"), "id", F.col("id").alias("label"), "data")
    return components(_linked(rows, _join_units(percent, _sketches, _sketch_links)), tables, name)


def set_links(
    sizes: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    expand: Callable[[list[bytes]], list[np.ndarray]],
    percent: int,
    tables: Tables,
    name: str,
) -> DataFrame:
    """node, label of all sets that have a link within their group, by signature trees and exact comparison."""
    return _group_links(sizes, read, _join_units(percent, expand, _set_links), percent, (UNIT_SETS, UNIT_VALUES), tables, name)


def _group_links(
    sizes: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    join: Callable,
    percent: int,
    limits: tuple[int, int],
    tables: Tables,
    name: str,
    known: DataFrame | None = None,
) -> DataFrame:
    """node, label of all sets that ``join`` links within their group.

    ``sizes``: group, id (long), n (the set's size), a row for every group that a set is in; ``read`` gives id and data (binary) for the ids of a table, each once, and perhaps
    more rows; ``join`` works on data. ``limits``: the most sets and values of a unit. ``known``: node, label of what is connected already.

    A unit holds sets of one group and of one class of sizes (similar sets lie in the same or in neighbouring classes), dealt by a hash of the id when
    there are many. Groups that fit one unit are done after the first round. For larger ones, components so far are carried into a round that joins each
    unit with the first of its class and of the next one, and then into a last round over all other pairs of units which hold more than one
    component between them. So a group of copies, however large, is connected by few comparisons, and yet no pair is skipped that may be a link.
    """
    step = float(np.log(100 / percent))
    sizes = sizes.withColumn("size_class", F.floor(F.log("n") / F.lit(step) + 1e-9).cast("int"))
    most_sets, most_values = limits
    whole = sizes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("values_in"))
    small = (F.col("sets") <= most_sets) & (F.col("values_in") <= most_values)
    classes = (
        sizes.groupBy("group", "size_class")
        .agg(F.count("*").alias("c"), F.sum("n").alias("v"))
        .join(whole, "group")
        .select(
            "group",
            "size_class",
            F.when(small, 0).otherwise(F.greatest(F.ceil(F.col("c") / most_sets), F.ceil(F.col("v") / most_values))).cast("int").alias("deals"),
        )
    )
    classes = tables.save(classes, f"{name}-classes")
    unit_of = F.when(F.col("deals") == 0, F.struct("group", F.lit(-1).alias("class"), F.lit(0).alias("deal"))).otherwise(
        F.struct("group", F.col("size_class").alias("class"), F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), "deals")).cast("int").alias("deal"))
    )
    units = tables.save(sizes.join(classes, ["group", "size_class"]).select(unit_of.alias("unit"), "id"), f"{name}-units")
    links = None

    def save(found: DataFrame, at: str) -> DataFrame:
        found = tables.save(found, at)
        return found if links is None else links.unionByName(found)

    if known is not None:
        links = tables.save(known.select(F.col("node").alias("a"), F.col("label").alias("b")), f"{name}-known")
    first = _labelled(units, known).join(read(units), "id").select("unit", F.lit(0).alias("side"), "id", "label", "data")
    links = save(_linked(first, join), f"{name}-links-0")
    large = classes.filter("deals > 0")
    if large.isEmpty():
        return components(links, tables, f"{name}-cc")
    tables.free()
    pairs = _unit_pairs(large)
    for k, some in enumerate((pairs.filter("hub"), pairs.filter("not hub")), 1):
        label = tables.save(components(links, tables, f"{name}-cc-{k}"), f"{name}-labels-{k}")
        labelled = tables.save(_labelled(units.filter("unit.class >= 0"), label), f"{name}-labelled-{k}")
        spans = labelled.groupBy("unit").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        sides = [spans.select(F.col("unit").alias(u), F.col("lo").alias(f"{u}_lo"), F.col("hi").alias(f"{u}_hi")) for u in ("x", "y")]
        mixed = some.join(sides[0], "x").join(sides[1], "y").filter("least(x_lo, y_lo) <> greatest(x_hi, y_hi)").select("x", "y")
        mixed = tables.save(mixed, f"{name}-mixed-{k}")
        if not mixed.isEmpty():
            to = mixed.select(F.col("x").alias("unit"), "x", "y", F.lit(0).alias("side")).unionByName(
                mixed.select(F.col("y").alias("unit"), "x", "y", F.lit(1).alias("side"))
            )
            rows = tables.save(to.join(labelled, "unit").select(F.struct("x", "y").alias("unit"), "side", "id", "label"), f"{name}-sides-{k}")
            more = rows.join(read(rows.select("id").distinct()), "id")
            links = save(_linked(more, join), f"{name}-links-{k}")
            tables.free()
    return components(links, tables, f"{name}-cc")


def _labelled(units: DataFrame, label: DataFrame | None) -> DataFrame:
    """unit, id, label: of a set that is connected with nothing its own id."""
    if label is None:
        return units.select("unit", "id", F.col("id").alias("label"))
    return units.join(label.withColumnRenamed("node", "id"), "id", "left").select("unit", "id", F.coalesce("label", "id").alias("label"))


def _unit_pairs(large: DataFrame) -> DataFrame:
    """x, y, hub: pairs of units of one group whose classes are the same or neighbours. A hub pair has the first unit of its class on one side."""
    one = large.select("group", "size_class", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))

    def unit(at: str) -> F.Column:
        return F.struct(F.col(f"{at}.group").alias("group"), F.col(f"{at}.size_class").alias("class"), F.col(f"{at}.deal").alias("deal"))

    def pairs(step: int) -> DataFrame:
        left = one.alias("l")
        right = one.select("group", (F.col("size_class") - step).alias("near"), "size_class", "deal").alias("r")
        joined = left.join(right, (F.col("l.group") == F.col("r.group")) & (F.col("l.size_class") == F.col("r.near")))
        if not step:
            joined = joined.filter("l.deal < r.deal")
        hub = (F.col("l.deal") == 0) | ((F.col("r.deal") == 0) & F.lit(bool(step)))
        return joined.select(unit("l").alias("x"), unit("r").alias("y"), hub.alias("hub"))

    return pairs(0).unionByName(pairs(1))


def shared_key_edges(entries: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b) between ids that share a key, as spanning forests; entries: part, keys (binary of uint64), ids (binary of int64), sizes (binary of int32).

    ``entries`` rows carry many keys each; what belongs to one part meets in one task, which goes through its parts one after another. Only neighbours in size are linked, as far as their sizes can go with a
    similarity of ``ratio``. Keys are narrow: the part and 32 bits more tell them apart, so that of the half million entries of a part some 30 pairs meet that share no key, which whoever compares the
    groups exactly finds out.
    """
    return entries.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_meet, "a long, b long")


def shared_key_groups(entries: DataFrame, tasks: int) -> DataFrame:
    """(group, id) of all runs of ids that share a key and are neighbours in size. Runs of the same ids have one name, so that equal ones become one group.

    Entries with a ``percent`` of 0 are of keys so hot that their ids don't meet here: the key names their group, and ids may be of any size.
    """
    return entries.repartition(tasks, "part").mapInArrow(_runs, "group long, id long").distinct()


def _met(batches: Iterator[pa.RecordBatch], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """key, id, and whether an entry goes on with the run of the one before it; sorted. All parts of a task together need no more memory than its entries."""
    keys, ids, sizes = [], [], []
    percent = 0
    for batch in batches:
        for k, i, n, p in zip(*(batch.column(c) for c in ("keys", "ids", "sizes")), batch.column("percent").to_pylist(), strict=True):
            keys.append(np.frombuffer(k.as_buffer(), dtype=kind))
            ids.append(np.frombuffer(i.as_buffer(), dtype=np.int64))
            sizes.append(np.frombuffer(n.as_buffer(), dtype=np.int32))
            percent = p
    if not keys:
        return None
    key, id_, size = np.concatenate(keys), np.concatenate(ids), np.concatenate(sizes).astype(np.int64)
    del keys, ids, sizes
    order = np.argsort(key) if size.min() == size.max() else np.lexsort((id_, size, key))
    key, id_, size = key[order], id_[order], size[order]
    return key, id_, (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The rows of each part of batches that come in order of their part."""
    held: list[pa.RecordBatch] = []
    own = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and part[a] != own:
                yield iter(held)
                held = []
            own = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield iter(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        met = _met(part, np.uint32)
        if met is not None:
            _, id_, near = met
            near &= id_[1:] != id_[:-1]
            nodes, label = least_labels(id_[:-1][near], id_[1:][near])
            apart = nodes != label
            yield pa.record_batch([pa.array(nodes[apart]), pa.array(label[apart])], names=["a", "b"])
    release()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hot: list[pa.RecordBatch] = []

    def others() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_hot = pc.equal(batch.column("percent"), 0)
            hot.append(batch.filter(of_hot))
            yield batch.filter(pc.invert(of_hot))

    met = _met(others())
    for batch in hot:
        for keys, ids in zip(batch.column("keys"), batch.column("ids"), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(x.as_buffer(), dtype=np.int64)) for x in (keys, ids)], names=["group", "id"])
    if met is None:
        return
    key, id_, near = met
    again = np.append(False, near & (id_[1:] == id_[:-1]))  # the same set from another task
    run = np.cumsum(np.append(True, ~near))[~again]
    id_ = id_[~again]
    first = np.flatnonzero(np.diff(run, prepend=0))
    length = np.diff(np.append(first, len(run)))
    with np.errstate(over="ignore"):
        name = mix(np.add.reduceat(mix(id_.view(np.uint64)), first) + length.astype(np.uint64))
    several = np.flatnonzero(length > 1)
    several = several[np.unique(name[several], return_index=True)[1]]
    for at in range(0, len(several), 1 << 16):
        some = several[at : at + (1 << 16)]
        n = length[some]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.record_batch([pa.array(np.repeat(name[some], n).view(np.int64)), pa.array(id_[np.repeat(first[some], n) + inside])], names=["group", "id"])
    del met, key, id_, near, again, run, first, length, name
    release()


def packed_entries(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, parts: int, percent: int, by: np.ndarray | None = None, narrow: bool = False) -> pa.RecordBatch:
    """The entries of a slice, a row for each part that has any. The parts are ranges of the keys, or of ``by``. ``narrow``: of each key only the low 32 bits, of which the part says nothing."""
    part = ((((keys if by is None else by) >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part, keys = part[order].astype(np.int64), keys[order].astype(np.uint32) if narrow else keys[order]
    ids, sizes = (x[order] if len(x) else x for x in (ids, sizes))  # keys may come alone
    cuts = np.flatnonzero(np.diff(part)) + 1
    begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
    full = begins < ends
    begins, ends = begins[full], ends[full]
    columns = [part[begins].tolist(), *([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)] for x in (keys, ids, sizes.astype(np.int32)))]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch(
        [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([percent] * len(begins), pa.int32())],
        names=["part", "keys", "ids", "sizes", "percent"],
    )


ENTRIES = "part int, keys binary, ids binary, sizes binary, percent int"
