"""Exact Jaccard join of word-shingle sets, as connected classes.

Jaccard distance is a metric, and the join works as a recursive metric-space join: pivots, the Voronoi regions around them, and windows
that the triangle inequality gives. Almost all sets of a corpus are at distance one from any pivot, so two exact steps come first:

1.  Equal sets are one set.
2.  Cells. A set's shingles are dealt to `m` slots by their hash. If linked sets can differ in at most `k` shingles, at most `k` slots
    differ, so of any `k + 1` slots that both put first one is the same in both: each set names the `k + 1` fullest. Sets that share no
    cell can't be linked; those that do, directly or through others, form a region.

A region of up to `most_sets` sets is joined in one task: each pivot takes in the ball around it. Members of one ball are linked through
their pivot and need no comparison. What stays for the next pivot is the rest, and of the ball only the boundary: members so far out
that the triangle inequality leaves them a chance to be within reach of the rest. When nothing is left, boundary members of different
balls have not met yet: each that may still reach a set outside its balls becomes a pivot too, except those of the largest class, as any
link between classes has another end.

A larger region is parted, its sets dealt over tasks. Pivots far from each other are drawn from it. The Voronoi region of a pivot holds
the sets within `2 * reach` of it, replicates of the boundary come in by the window of one reach more, and what is in no region stays
together. In a pivot's region a set is held as its difference from the pivot. Sets in the pivot's ball are one class already, so a pair
still to be found has an end outside of it, and by the triangle inequality it shares over half of the inner set's difference; sets in no
region share most of all they have. Pairs that share none of the rarest elements that this leaves are out. What still hangs together by
the elements left are regions again: joined in one task where they are small, else element by element, and by those elements that very
many sets share parted again. After `rounds` rounds regions that are still large are joined block by block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .textarrow import coded, hashed, lower_table, mixed, pieces, remap, row_of, split_words, windows


def size_classes(largest: int) -> np.ndarray:
    """First sizes of the classes; neighbours are over 1.176 times apart, so linked sets (0.85 or more) are in one class or in adjacent ones."""
    out = [1]
    while out[-1] <= 2 * largest:
        out.append(out[-1] * 3 // 2 + 1)
    return np.array(out)


def most_apart(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles linked sets of these sizes may differ."""
    return (100 - percent) * (size + other) // (100 + percent)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text (64-bit hashes, ascending), and the rows' first places."""
    flat, at = split_words(remap(texts, lower_table()))
    code, words = coded(flat)
    win, first = windows(hashed(words)[code], at, n)
    row = row_of(first)
    order = np.lexsort((win, row))
    win, row = win[order], row[order]
    fresh = np.ones(len(win), bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(win) != 0)
    win, row = win[fresh], row[fresh]
    return win, np.searchsorted(row, np.arange(len(at)))


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by group, modulo 2**64 (halves are summed apart, exactly in doubles)."""
    low = np.bincount(group, weights=(values & np.uint64(0xFFFFFFFF)).astype(float), minlength=n).astype(np.uint64)
    high = np.bincount(group, weights=(values >> np.uint64(32)).astype(float), minlength=n).astype(np.uint64)
    with np.errstate(over="ignore"):
        return low + (high << np.uint64(32))


def set_names(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names."""
    return mixed(sums(mixed(sets), row_of(first), len(first) - 1) + np.diff(first).astype(np.uint64))


def cells(sets: np.ndarray, first: np.ndarray, percent: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell name) of every set. A set takes part in its own size class and, where a linked larger set may be in it, in the next.

    A class has half as many slots again as linked sets need. Each set names its fullest ones, as many as it needs: of the slots that two
    linked sets have in common, the fullest is among those of both. Full slots say more, so fewer sets meet that have little in common.
    """
    size = np.diff(first)
    starts = size_classes(int(size.max(initial=1)))
    last = starts[1:] - 1
    slots = -(-3 * (most_apart(last, last, percent) + 1) // 2)
    own = np.searchsorted(starts, size, side="right") - 1
    rows, names = [], []
    for step in (0, 1):
        kind = np.clip(own + step, 0, len(last) - 1)
        use = size > 0
        if step:
            use &= 100 * size >= percent * starts[kind]
        chosen = np.flatnonzero(use)
        m = slots[kind[chosen]]
        needed = most_apart(size[chosen], np.minimum(last[kind[chosen]], 100 * size[chosen] // percent), percent) + 1
        base = np.cumsum(m) - m
        member = np.repeat(use, size)
        rank = np.repeat(np.arange(len(chosen)), size[chosen])
        value = mixed(sets[member] + np.uint64(salt))
        slot = base[rank] + (value % m[rank].astype(np.uint64)).astype(np.int64)
        total, count = sums(mixed(value), slot, int(m.sum())), np.bincount(slot, minlength=int(m.sum()))
        owner = np.repeat(np.arange(len(chosen)), m)
        inner = np.arange(len(owner)) - base[owner]
        tag = mixed(inner.astype(np.uint64) * np.uint64(4096) + kind[chosen][owner].astype(np.uint64))
        # The fullest come last; owners keep their places, as each has all its slots.
        by = np.lexsort((inner, count, owner))
        keep = by[inner >= (m - needed)[owner]]
        rows.append(chosen[owner[keep]])
        names.append(mixed(total[keep] ^ tag[keep]))
    return np.concatenate(rows), np.concatenate(names)


def within(first: np.ndarray, second: np.ndarray, inter: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (first + second - inter)


class Region:
    """Sets of one region, as postings, so that one pass gives a set's distances to all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        _, self.code = np.unique(every, return_inverse=True)
        order = np.argsort(self.code, kind="stable")
        self.owner = row_of(self.start)[order]
        self.posting = np.concatenate([[0], np.cumsum(np.bincount(self.code, minlength=1))])

    def shared(self, i: int) -> np.ndarray:
        """Size of the intersection of set i with every set."""
        own = self.code[self.start[i] : self.start[i + 1]]
        a, n = self.posting[own], self.posting[own + 1] - self.posting[own]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.size))

    def central(self) -> np.ndarray:
        """Sets in the order in which they make pivots: those whose shingles the most others have first."""
        df = np.diff(self.posting)[self.code]
        return np.argsort(-np.add.reduceat(df, self.start[:-1]) / self.size, kind="stable")


def linked_classes(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Class of each set (the place of one of its members) under all links of a region."""
    n = len(sets)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    region, reach = Region(sets), 1 - percent / 100
    active, rest = np.ones(n, bool), np.ones(n, bool)
    spare = np.full(n, -np.inf)  # how much further than the reach a set is, at least, from all that share no ball with it

    def take(p: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link p with those of `of` in its ball; distances to all sets, and the ball."""
        inter = region.shared(p)
        distance = 1 - inter / (region.size + region.size[p] - inter)
        near = within(region.size, region.size[p], inter, percent)
        ball = of & near
        for i in np.flatnonzero(ball):
            a, b = root(i), root(p)
            parent[max(a, b)] = min(a, b)
        # Sets out of the ball are `gap` from p or more, so from a member at distance d they are gap - d or more.
        gap = distance[~near].min(initial=np.inf)
        spare[near] = np.maximum(spare[near], gap - distance[near] - reach)
        spare[p] = np.inf
        return distance, ball

    order = region.central()
    for p in order:
        if not rest[p]:
            continue
        distance, ball = take(p, active)
        rest &= ~ball
        active[p] = rest[p] = False
        if not rest.any():
            break
        # Of what pivots have taken in, only the boundary can still reach the rest.
        active &= rest | ~ball | (distance >= distance[rest].min() - reach - 1e-9)
    label = np.array([root(i) for i in range(n)])
    largest = label == np.bincount(label).argmax() if n else label
    every = np.ones(n, bool)
    for p in order:
        # A set with room to spare reaches only members of its pivots' balls, with which it is linked.
        if not largest[p] and spare[p] <= 1e-9:
            take(p, every)
    return np.array([root(i) for i in range(n)])


def lower_ends(edges: DataFrame) -> DataFrame:
    """`a, ends`: the distinct lower nodes that each node is connected with, ascending."""
    return edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("ends"))


def handed_down(ends: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: each node keeps its least end, and its other ends are connected with that one."""
    kept = F.array(F.struct("a", F.col("ends")[0].alias("b")))
    others = F.transform(F.slice("ends", F.lit(2), F.size("ends")), lambda x: F.struct(x.alias("a"), F.col("ends")[0].alias("b")))
    return ends.select(F.inline(F.concat(kept, others)))


def components(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """`node, label` of all ends of `edges` (a, b): the smallest node that each reaches.

    Nodes hand their edges down until each has one, to a lower node: then the edges are trees, and each node's end is replaced by that
    end's own, which halves the way to the root each time. What is read again is written to the shared folder. A node's ends are no more
    than it has edges to lower nodes, however many higher ones there are.
    """
    ends = lower_ends(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        for _ in range(rounds):
            ends = lower_ends(handed_down(ends))
        ends = stored(ends, "edges")
        if not ends.where(F.size("ends") > 1).limit(1).count():
            break
    trees = ends.select(F.col("a").alias("node"), F.col("ends")[0].alias("label"))
    while True:
        up = trees.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = stored(trees.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "labels")
        trees = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            break
    return trees.union(trees.select(F.col("label").alias("node"), "label").distinct())


LINKS = "a long, b long"


def _split(table: pa.Table) -> list[np.ndarray]:
    """The arrays of a table's list column `items`, each ascending and free of repeats."""
    items = table.column("items").combine_chunks()
    start, flat = items.offsets.to_numpy(), items.values.to_numpy()
    return [flat[a:b] for a, b in zip(start[:-1], start[1:])]


def join_regions(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked sets of each region; members: `region, name, items`."""

    def join(table: pa.Table) -> pa.Table:
        names, at = np.unique(table.column("name").to_numpy(), return_index=True)
        label = linked_classes(_split(table.take(pa.array(at))), percent)
        other = label != np.arange(len(label))
        return pa.table({"a": names[other], "b": names[label[other]]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return members.groupBy("region").applyInArrow(join, LINKS)


def star(rows: DataFrame, key: list[str]) -> DataFrame:
    """Edges (a, b) from each `node` of a group to the least of its group."""
    least = F.min("node").over(Window.partitionBy(*key))
    return rows.select("node", least.alias("least")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))


def draw_pivots(members: DataFrame, large: DataFrame, percent: int, most_shingles: int, sample: int, pivots: int) -> DataFrame:
    """`region, pivot, items`: of some sets of each region the most central, and then those far from all drawn before."""
    far = 4 * (1 - percent / 100)
    # Few where sets are very large: what one task gets of a region is bounded.
    most = F.greatest(F.lit(2), F.least(F.lit(sample), F.floor(most_shingles * F.col("sets") / F.col("shingles")).cast("int")))
    order = Window.partitionBy("region").orderBy(F.xxhash64("name", "region"))
    drawn = members.select("region", "name").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    drawn = drawn.join(large.select("region", most.alias("most")), "region").where("nth <= most").select("region", "name")

    def choose(table: pa.Table) -> pa.Table:
        sets = _split(table)
        region, n = Region(sets), len(sets)
        apart = np.ones((n, n))
        for i in range(n):
            inter = region.shared(i)
            apart[i] = 1 - inter / (region.size + region.size[i] - inter)
        chosen: list[int] = []
        for i in np.lexsort((apart.sum(1), -(apart <= 1 - percent / 100).sum(1))):
            if len(chosen) < pivots and (apart[i, chosen] > far).all():
                chosen.append(int(i))
        return table.take(pa.array(chosen)).select(["region", "name", "items"]).rename_columns(["region", "pivot", "items"])

    return members.join(drawn, ["region", "name"]).groupBy("region").applyInArrow(choose, "region long, pivot long, items array<long>")


def place(members: DataFrame, chosen: DataFrame, large: DataFrame, percent: int, most_sets: int, most_shingles: int) -> DataFrame:
    """`part, name, pivot, size, pivot_size, inside, apart`: sets in their pivots' Voronoi regions with their difference from the pivot, and sets
    in no region with their difference from nothing, which is all of them. A set in the window of several regions has a row for each."""
    reach = 1 - percent / 100
    # Sets of a region are dealt to as many tasks as it needs, and its pivots go to each.
    shards = F.ceil(F.greatest(F.col("sets") / most_sets, F.col("shingles") / most_shingles)).cast("int")
    large = large.select("region", shards.alias("shards"))
    left = members.join(large, "region").withColumn("shard", F.pmod(F.xxhash64("name"), F.col("shards")).cast("int"))
    right = chosen.join(large, "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]
    names = ["part", "name", "pivot", "size", "pivot_size", "inside", "apart"]

    def measure(sets: pa.Table, pivots: pa.Table) -> pa.Table:
        own, centres, out = _split(sets), _split(pivots), []
        name, region = sets.column("name").to_pylist(), np.array(pivots.column("region").to_numpy()[:1], np.int64).view(np.uint64)
        every = Region(centres + own)
        size, free = every.size[len(centres) :], np.ones(len(own), bool)
        for i, (pivot, centre) in enumerate(zip(pivots.column("pivot").to_pylist(), centres)):
            inter = every.shared(i)[len(centres) :]
            distance = 1 - inter / (size + len(centre) - inter)
            near = within(size, len(centre), inter, percent)
            part = int(mixed(region ^ mixed(np.array([pivot], np.int64).view(np.uint64))).view(np.int64)[0])
            free &= distance > 2 * reach
            for j in np.flatnonzero(distance <= 3 * reach + 1e-9):
                out.append((part, name[j], pivot, size[j], len(centre), bool(near[j]), np.setxor1d(own[j], centre, assume_unique=True)))
        rest = int(mixed(region + np.uint64(1)).view(np.int64)[0])
        out += [(rest, name[j], None, size[j], 0, False, own[j]) for j in np.flatnonzero(free)]
        return pa.table([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    schema = "part long, name long, pivot long, size long, pivot_size long, inside boolean, apart array<long>"
    left, right = left.select("region", "shard", "name", "items"), right.select("region", "shard", "pivot", "items")
    return left.groupBy("region", "shard").cogroup(right.groupBy("region", "shard")).applyInArrow(measure, schema)


def meeting(placed: DataFrame, percent: int) -> DataFrame:
    """`part, node, token`, such that linked sets of a part that its pivot doesn't link share a token; a set's `node` is its name in a part.

    With `a` and `b` the differences of x and y from pivot p, linked sets have `q (a + b - 2 c) <= r (|x| + |y|)`, where c is what the
    differences share, q = 100 + percent and r = 100 - percent. If y is outside of p's ball, `q b > r (|y| + |p|)`, so
    `2 q c > q a + r (|p| - |x|)`; and `c >= b - (most that y and a set linked with it differ in)`. Without a pivot, c is what the sets share,
    `percent` of a or more. Two differences that share c elements share one among the rarest `a - c + 1` of the one and the rarest
    `b - c + 1` of the other.
    """
    q, r = 100 + percent, 100 - percent
    held = placed.withColumn("node", F.xxhash64("part", "name"))
    each = held.select("part", "node", F.explode("apart").alias("token"))
    often = each.groupBy("part", "token").agg(F.count("*").alias("often")).where("often > 1")
    shared = each.join(often, ["part", "token"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("shared"))
    n = F.size("apart").cast("long")
    half = n - F.floor((q * n + r * (F.col("pivot_size") - F.col("size"))) / (2 * q)).cast("long")
    half = F.when(F.col("pivot").isNull(), n - F.ceil(percent * n / 100) + 1).otherwise(half)
    long = n - F.greatest(F.lit(1), n - F.floor(r * (F.col("size") + F.floor(100 * F.col("size") / percent)) / q)) + 1
    long = F.when(F.col("inside") | F.col("pivot").isNull(), half).otherwise(F.greatest(half, long))
    # Differences that no other set has are the rarest, and none meets another.
    kept = held.join(shared, "node").select("part", "node", "inside", "shared", half.alias("half"), long.alias("long"), (n - F.size("shared")).alias("lone"))
    rows = kept.select("part", "node", "inside", (F.col("half") - F.col("lone")).alias("half"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("long") - F.col("lone")).cast("int"))).alias("nth", "x"))
    rows = rows.select("part", "node", "inside", (F.col("nth") < F.col("half")).alias("first"), F.col("x.token").alias("token"))
    # Ends outside of the ball meet those inside by `long` and each other by `half`; ends inside have met by the pivot.
    kinds = rows.groupBy("part", "token").agg(F.max("inside").alias("any_inside"), F.min("inside").alias("only_inside"))
    rows = rows.join(kinds, ["part", "token"]).where("not only_inside and (any_inside or first)")
    return rows.select("part", "node", "token")


def block_regions(members: DataFrame, sizes: DataFrame, most_sets: int) -> DataFrame:
    """Regions that hold each pair of blocks of a region once, so that every two of its sets meet."""
    blocks = F.ceil(2 * F.col("sets") / most_sets)
    placed = members.join(sizes.select("region", blocks.cast("int").alias("blocks")), "region").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    return placed.select("region", "name", "items", F.explode(pairs).alias("x")).select(F.xxhash64("region", "x.i", "x.j").alias("region"), "name", "items")


def large_region_links(members: DataFrame, sizes: DataFrame, percent: int, most_sets: int, most_shingles: int, sample: int = 64, pivots: int = 8, rounds: int = 6) -> DataFrame:
    """Links that connect all linked sets of regions that are too large for one task; members: `region, name, items`, sizes: `region, sets,
    shingles`."""
    sets = members.select("name", "items")
    out: list[DataFrame] = []
    for level in range(rounds):
        chosen = stored(draw_pivots(members, sizes, percent, most_shingles, sample, pivots), "region-pivots")
        placed = stored(place(members, chosen, sizes, percent, most_sets, most_shingles), "region-parts")
        out.append(placed.where("inside and name <> pivot").select(F.col("name").alias("a"), F.col("pivot").alias("b")))
        met = stored(meeting(placed, percent), "region-tokens")
        nodes = placed.select(F.xxhash64("part", "name").alias("node"), "name", "size").distinct()
        labels = components(star(met, ["part", "token"])).select("node", F.col("label").alias("region"))
        sized = stored(sizes_of(nodes.join(labels, "node"), most_sets, most_shingles), "region-sizes")
        parted = [nodes.join(labels, "node").join(sized.where("not large").select("region"), "region")]
        sizes, hot = None, None
        if sized.where("large").limit(1).count():
            # What hangs together by single tokens is joined token by token; tokens that very many sets share make the next round's regions.
            named = met.join(labels.join(sized.where("large").select("region"), "region").select("node"), "node").withColumn("region", F.xxhash64("part", "token", F.lit(0)))
            often = stored(sizes_of(named.join(nodes, "node"), most_sets, most_shingles), "region-sizes")
            parted.append(named.join(often.where("not large and sets > 1").select("region"), "region").join(nodes, "node"))
            if often.where("large").limit(1).count():
                hot = components(star(named.join(often.where("large").select("region"), "region"), ["region"])).select("node", F.col("label").alias("region"))
                sized = stored(sizes_of(nodes.join(hot, "node"), most_sets, most_shingles), "region-sizes")
                parted.append(nodes.join(hot, "node").join(sized.where("not large").select("region"), "region"))
                sizes = sized.where("large")
        small = reduce(DataFrame.union, [x.select("region", "name") for x in parted])
        out.append(join_regions(small.join(sets, "name").select("region", "name", "items"), percent))
        if sizes is None or not sizes.limit(1).count():
            break
        members = nodes.join(hot, "node").join(sizes.select("region"), "region").join(sets, "name").select("region", "name", "items")
        members = stored(members.dropDuplicates(["region", "name"]), "region-members")
    else:
        counted = sizes.select("region", F.greatest("sets", F.ceil(F.col("shingles") / most_shingles) * most_sets).alias("sets"))
        out.append(join_regions(block_regions(members, counted, most_sets), percent))
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links


def sizes_of(rows: DataFrame, most_sets: int, most_shingles: int) -> DataFrame:
    """`region, sets, shingles, large` of rows `region, size`."""
    sized = rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    return sized.withColumn("large", large_region(most_sets, most_shingles))


def large_region(most_sets: int, most_shingles: int) -> Column:
    """Whether a region is more than one task should hold."""
    return (F.col("sets") > most_sets) | ((F.col("shingles") > most_shingles) & (F.col("sets") > 2))


def jaccard_classes(
    docs: DataFrame, n: int = 4, percent: int = 85, most_sets: int = 1024, most_shingles: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of `docs`: `doc_id, key, n_shingles, component_id`; `key` is the text's xxhash64, for joining back where ids repeat.

    A text's set is its distinct n-word shingles (words between ASCII white space, A-Z lower-cased); with fewer words, all of them as
    one. Two rows link when 100 * intersection >= percent * union, and `component_id` is the smallest id reachable. A text without
    words, or null, has an empty set and links with nothing; a row with a null id takes no part and has a null class. Ids may repeat:
    each row has its own set. `percent` is 85 or more, as the size classes assume. Other columns are ignored.
    """
    if percent < 85:
        raise ValueError("percent is under 85")

    def measure(batches):
        for batch in pieces(batches, "text"):
            sets, first = shingle_sets(batch.column("text"), n)
            size = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size), pa.array(set_names(sets, first).view(np.int64), mask=size == 0)], ["doc_id", "key", "n_shingles", "name"])

    def deal(batches):
        for batch in pieces(batches, "text"):
            sets, first = shingle_sets(batch.column("text"), n)
            name, size = set_names(sets, first).view(np.int64), np.diff(first)
            # Equal sets of a batch are dealt once.
            once = np.zeros(len(size), bool)
            once[np.unique(name, return_index=True)[1]] = True
            once &= size > 0
            row, cell = cells(sets[np.repeat(once, size)], np.concatenate([[0], np.cumsum(size[once])]), percent)
            name, cell = name[once][row], cell.view(np.int64)
            # Sets that share a cell here are linked up here, and the least stands for them.
            by = np.lexsort((name, cell))
            name, cell = name[by], cell[by]
            head = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
            least = name[np.flatnonzero(head)][np.cumsum(head) - 1] if len(cell) else name
            cell = np.where(head, cell, mixed(name.view(np.uint64) + np.uint64(1)).view(np.int64))
            fresh = head | (name != least)
            yield pa.RecordBatch.from_arrays([pa.array(name[fresh]), pa.array(cell[fresh]), pa.array(least[fresh], mask=head[fresh])], ["node", "cell", "near"])

    def collect(batches):
        for batch in pieces(batches, "text"):
            sets, first = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("name"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))], ["region", "name", "items"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    found = stored(rows.mapInArrow(measure, "doc_id long, key long, n_shingles long, name long"), "jaccard-sets")
    named = found.where("doc_id is not null and name is not null")
    held = rows.where("doc_id is not null").mapInArrow(deal, "node long, cell long, near long")
    least = F.when(F.col("near").isNull(), F.min("node").over(Window.partitionBy("cell"))).otherwise(F.col("near"))
    edges = held.select("node", least.alias("least")).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    regions = components(edges).select(F.col("node").alias("name"), F.col("label").alias("region"))
    one = named.join(regions, "name").groupBy("name", "region").agg(F.min(F.struct("doc_id", "key", "n_shingles")).alias("x"))
    one = stored(one.select("name", "region", "x.*"), "region-names")
    sizes = stored(sizes_of(one.withColumnRenamed("n_shingles", "size"), most_sets, most_shingles), "region-sizes")

    wanted = one.select("doc_id", "key", "region", "name")
    # A merge join at every size: a small side would be broadcast, one of a corpus can not.
    members = rows.join(wanted.hint("merge"), ["doc_id", "key"]).select("region", "name", "text").mapInArrow(collect, "region long, name long, items array<long>")
    members = stored(members, "region-members")
    links, large = join_regions(members.join(sizes.where("not large").select("region"), "region"), percent), sizes.where("large")
    if large.limit(1).count():
        # Rows alike in id and text are one member.
        inner = members.join(large.select("region"), "region").dropDuplicates(["region", "name"])
        links = links.union(large_region_links(stored(inner, "region-members"), large, percent, most_sets, most_shingles))
    links = components(links).select(F.col("node").alias("name"), "label")
    classed = found.join(links, "name", "left").withColumn("label", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "name")))
    least = classed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return classed.join(least, "label", "left").select("doc_id", "key", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without those that a class of near-duplicates has besides its smallest id's (of that id's several texts, one).

    Rows with a null id stay, as they take no part. Columns stay as they are.
    """
    first = Window.partitionBy("component_id").orderBy("doc_id", "key")
    kept = jaccard_classes(docs, **options).where("doc_id = component_id").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    kept = kept.select(F.col("doc_id").alias("id"), "key")
    # The rows are held in one column, so that no name of theirs clashes.
    rows = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    rows = rows.join(kept, ["id", "key"], "left_semi")
    # Rows alike in id and text are one document.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))).where("nth = 1")
    return rows.select("row.*").unionByName(docs.where("doc_id is null"))
