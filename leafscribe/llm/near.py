"""Near copies of page texts by a chosen-path similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import bound_batches, copied, pin, slices
from leafscribe.llm.components import components
from leafscribe.llm.passages import joined_hashes, mix, word_hashes

#: Words of a shingle, and the similarity (in hundredths) from which two pages are linked.
SHINGLE = 5
PERCENT = 75
#: Minwise tokens of a page, trees, tokens that a tree chooses at its start, and levels below that. A node chooses two tokens.
TOKENS, TREES, START, DEPTH = 64, 56, 3, 5
#: Trees whose small nodes are linked by forests, one portion after the other. A pair at the least similarity shares no node of these
#: with probability 0.0015, so the nodes of all trees are next compared in pairs, and mostly hold one component by then.
PORTIONS = ((0, 4), (4, 12))
#: Pages of a node that are compared exhaustively; larger nodes branch on, and at full depth are compared in blocks.
SMALL = 2048
#: Pages of a node whose whole texts are held together to verify candidates; the pairs of a larger node are parted.
HELD = 256
#: Pairs of a node that are looked at together.
PAIRS = 1 << 16
#: Partners of a page whose sets are compared with its own at once.
TOGETHER = 64
#: Pages of a large node that stand in each of its blocks, so that near copies in different blocks are linked early.
LEADERS = 4
#: Equal minwise tokens (of 64) from which a pair is verified. A pair at 0.75 has 48 on average, deviation 3.5.
LEAST_EQUAL = 32
SEED = 23

_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 2**32, TOKENS, np.uint32)
_ODD = _random.integers(0, 2**32, TOKENS, np.uint32) | np.uint32(1)
_ROOTS = _random.integers(0, 2**63, TREES, np.uint64)
#: Tokens that each tree chooses at its start.
_CHOSEN = np.array([_random.choice(TOKENS, START, replace=False) for _ in range(TREES)])
#: A place in the trees is tree * 64 + heap index: a start node has index 1, the children of h have 2h and 2h + 1.
_PLACES = np.arange(TREES, dtype=np.int32) * 64 + 1


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, one text after the other, and their numbers."""
    hashes, counts = word_hashes(texts, lower=True)
    first = np.cumsum(counts) - counts
    inside = np.maximum(counts - width + 1, 0)
    row = np.repeat(np.arange(len(texts)), inside)
    at = np.arange(len(row)) - np.repeat(np.cumsum(inside) - inside, inside) + first[row]
    found = joined_hashes(hashes, width)[at] if len(row) else np.zeros(0, np.uint64)
    # A text of fewer words is one shingle; its length goes into the hash.
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = [
        mix(joined_hashes(hashes[first[i] : first[i] + counts[i]], int(counts[i])), np.array([counts[i]], np.uint64))[0]
        for i in short
    ]
    row, found = np.concatenate([row, short]), np.concatenate([found, np.array(whole, np.uint64)])
    order = np.lexsort([found, row])
    row, found = row[order], found[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    return found[new], np.bincount(row[new], minlength=len(texts))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch["text"]):
                found, counts = shingles(texts, width)
                full = np.flatnonzero(counts)
                offsets = (np.cumsum(counts) - counts)[full]
                tokens = np.zeros((len(texts), TOKENS), "<u4")
                prints = np.zeros(len(texts), np.uint64)
                if len(full):
                    high = (found >> np.uint64(32)).astype(np.uint32)
                    for t in range(TOKENS):
                        tokens[full, t] = np.minimum.reduceat((high ^ _XOR[t]) * _ODD[t], offsets)
                    salt = np.full(len(found), SEED, np.uint64)
                    prints[full] = mix(np.add.reduceat(mix(found, salt), offsets), counts[full].astype(np.uint64))
                rows = batch.slice(start, len(texts))
                yield pa.record_batch(
                    [
                        rows["doc_id"],
                        rows["digest"],
                        pa.array(counts.astype(np.int64)),
                        pa.array(prints.view(np.int64)),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    ["doc_id", "digest", "n_shingles", "set_id", "tokens"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def _chosen(node: np.ndarray) -> np.ndarray:
    """The two tokens that each node chooses by its own hash."""
    first, step = node % np.uint64(TOKENS), (node >> np.uint64(6)) % np.uint64(TOKENS - 1) + np.uint64(1)
    return np.stack([first, (first + step) % np.uint64(TOKENS)], axis=-1)


def _child(node: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(mix(node, token), value.astype(np.uint64))


def _starts(tokens: np.ndarray) -> np.ndarray:
    """The start node of each page in each tree: that of its values of all tokens that the tree chooses there."""
    node = np.repeat(_ROOTS[None, :], len(tokens), 0)
    for step in range(START):
        node = mix(node, tokens[:, _CHOSEN[:, step]].astype(np.uint64))
    return node


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start nodes of each page, one a tree."""
    for batch in batches:
        if batch.num_rows:
            node = _starts(_matrix(batch["tokens"]))
            places = np.tile(_PLACES, batch.num_rows)
            own = batch["set_id"].take(pa.array(np.repeat(np.arange(batch.num_rows), TREES)))
            yield pa.record_batch([pa.array(node.ravel().view(np.int64)), pa.array(places), own], ["node", "place", "set_id"])


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each page at its node: equal values of a chosen token go the same way."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tokens = _matrix(batch["tokens"])
        node, place = batch["node"].to_numpy().view(np.uint64), batch["place"].to_numpy()
        chosen = _chosen(node)
        value = np.take_along_axis(tokens, chosen.astype(np.int64), 1)
        child = _child(np.repeat(node[:, None], 2, 1), chosen, value)
        tree, heap = np.divmod(place, 64)
        places = (tree * 64 + 2 * heap)[:, None] + np.arange(2)
        yield pa.record_batch(
            [
                pa.array(child.ravel().view(np.int64)),
                pa.array(places.ravel().astype(np.int32)),
                batch["set_id"].take(pa.array(np.repeat(np.arange(batch.num_rows), 2))),
            ],
            ["node", "place", "set_id"],
        )


def _earliest(tokens: np.ndarray, marks: np.ndarray, i: np.ndarray, j: np.ndarray, place: int) -> np.ndarray:
    """For pairs of pages at one compared node: False where an earlier compared node holds both, too.

    A pair's common nodes follow from its equal tokens, and `marks` tells which of them branched on.
    """
    tree, heap = divmod(place, 64)
    first = np.ones(len(i), bool)
    equal = tokens[i] == tokens[j]
    for t in range(tree + 1):
        at = np.flatnonzero(equal[:, _CHOSEN[t]].all(1) & first)
        open_nodes = [(1, _starts(tokens[i[at]])[:, t], at)] if len(at) else []
        while open_nodes:
            g, node, pair = open_nodes.pop()
            branched = (marks[i[pair], t] >> g) & 1 == 1
            if t < tree or g < heap:
                first[pair[~branched]] = False
            node, pair = node[branched], pair[branched]
            chosen = _chosen(node)
            for slot in (0, 1):
                token = chosen[:, slot]
                same = equal[pair, token.astype(np.int64)]
                if same.any():
                    value = tokens[i[pair[same]], token[same].astype(np.int64)]
                    open_nodes.append((2 * g + slot, _child(node[same], token[same], value), pair[same]))
    return first


def _closest(tokens: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the closest pages of a node, between different labels."""
    # Prim: always the closest page that is still outside.
    n = len(labels)
    best, near = np.full(n, -1), np.zeros(n, np.int64)
    outside, last, found = np.ones(n, bool), 0, []
    outside[0] = False
    for _ in range(n - 1):
        equal = (tokens == tokens[last]).sum(1)
        closer = outside & (equal > best)
        best[closer], near[closer] = equal[closer], last
        last = int(np.where(outside, best, -2).argmax())
        outside[last] = False
        if best[last] >= LEAST_EQUAL and labels[last] != labels[near[last]]:
            found.append((last, near[last]))
    both = np.array(found, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _close(tokens, labels, marks, sides, place: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a node with enough equal tokens and different labels that no earlier node holds."""
    left, right = [], []
    across = sides.any() and not sides.all()
    for i in range(len(labels) - 1):
        good = ((tokens[i + 1 :] == tokens[i]).sum(1) >= LEAST_EQUAL) & (labels[i + 1 :] != labels[i])
        if across:
            good &= sides[i + 1 :] != sides[i]
        found = np.flatnonzero(good) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    i, j = np.concatenate(left), np.concatenate(right)
    some = [slice(at, at + PAIRS) for at in range(0, len(i), PAIRS)]
    first = [np.zeros(0, bool), *(_earliest(tokens, marks, i[s], j[s], place) for s in some)]
    first = np.concatenate(first)
    return i[first], j[first]


def _by_label(labels: np.ndarray) -> np.ndarray:
    """Place of each page of a node when pages of rare labels come first and those of one label stand together."""
    _, label, counts = np.unique(labels, return_inverse=True, return_counts=True)
    place = np.empty(len(labels), np.int64)
    place[np.lexsort([label, counts[label]])] = np.arange(len(labels))
    return place


def _held(
    node: int, size: int, i: np.ndarray, j: np.ndarray, place: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The candidates of a node by parts that touch `HELD` pages at most, each under a number of its own.

    Parts follow the places of the pages: with `_by_label` the few outside a large component share few parts, each page of it
    meets them there, and no part is spent on pages of one component.
    """
    if size <= HELD or len(np.union1d(i, j)) <= HELD:
        yield node, i, j
        return
    one, other = (i, j) if place is None else (place[i], place[j])
    one, other = np.minimum(one, other) // (HELD // 2), np.maximum(one, other) // (HELD // 2)
    part = one.astype(np.uint64) << np.uint64(32) | other.astype(np.uint64)
    for p in np.unique(part):
        own = part == p
        number = mix(np.array([node], np.int64).view(np.uint64), np.array([p], np.uint64)).view(np.int64)[0]
        yield number, i[own], j[own]


def _by_node(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """`work` per table of whole nodes; rows come sorted by node, and a node, bounded in size, may go on in the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        node = table["node"].to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        if cut:
            yield work(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
    if rest is not None:
        yield work(rest.combine_chunks())


def _bounds(node: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
    return zip(at.tolist(), at[1:].tolist(), strict=False)


def _compare(forest: bool):
    """Pages of each node that have candidates there, with their partners; a pair stands at one of its two pages."""

    def done(table: pa.Table) -> pa.RecordBatch:
        node, ids, labels = (table[c].to_numpy() for c in ("node", "set_id", "label"))
        tokens = _matrix(table["tokens"].combine_chunks())
        nodes, members, partners, lengths = [], [], [], []
        if not forest:
            places, sides = table["place"].to_numpy(), table["side"].to_numpy()
            marks = np.array(table["marks"].to_pylist(), np.int64)
        for a, b in _bounds(node):
            if b - a < 2:
                continue
            if forest:
                i, j = _closest(tokens[a:b], labels[a:b])
            else:
                i, j = _close(tokens[a:b], labels[a:b], marks[a:b], sides[a:b], int(places[a]))
            for number, x, y in _held(node[a], b - a, i, j, _by_label(labels[a:b])):
                order = np.argsort(x, kind="stable")
                counts = np.bincount(x, minlength=b - a)
                own = np.union1d(x, y)
                nodes.append(np.full(len(own), number))
                members.append(ids[a:b][own])
                partners.append(ids[a:b][y[order]])
                lengths.append(counts[own])
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        offsets = np.concatenate([[0], np.cumsum(join(lengths))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(partners)))
        return pa.record_batch([pa.array(join(nodes)), pa.array(join(members)), lists], ["node", "set_id", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_node(batches, done)

    return run


def _mixed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows, with the label of each page so far, of the nodes that hold more than one label."""
    if labels is None:
        return rows.withColumn("label", F.col("set_id"))
    known = copied(labels.select(F.col("id").alias("set_id"), "component"))
    rows = rows.join(known, "set_id", "left").withColumn("label", F.coalesce("component", "set_id")).drop("component")
    mixed = rows.groupBy("node").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h")
    return rows.join(mixed.select("node"), "node", "left_semi")


def _common(own: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of hashes that each of the other sets (not empty, sorted) has in common with one, and their sizes."""
    sizes = np.array([len(other) for other in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    return np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(sizes) - sizes), sizes


def _verify(width: int, percent: int):
    """Links among the candidates of each node, by the whole sets of its pages."""

    def done(table: pa.Table) -> pa.RecordBatch:
        ids, partners = table["set_id"].to_pylist(), table["partners"].to_pylist()
        node, texts = table["node"].to_numpy(), table["text"].combine_chunks()
        left, right = [], []
        for a, b in _bounds(node):
            sets = {}
            for start, part in slices(texts.slice(a, b - a)):
                found, counts = shingles(part, width)
                sets |= zip(ids[a + start : a + start + len(part)], np.split(found, np.cumsum(counts)[:-1]), strict=True)
            for one, others in zip(ids[a:b], partners[a:b], strict=True):
                for at in range(0, len(others), TOGETHER):
                    near = others[at : at + TOGETHER]
                    common, sizes = _common(sets[one], [sets[other] for other in near])
                    linked = np.flatnonzero(100 * common >= percent * (len(sets[one]) + sizes - common))
                    left += [one] * len(linked)
                    right += [near[k] for k in linked]
        return pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_node(batches, done)

    return run


def _once(near: DataFrame) -> DataFrame:
    """The same candidates with each pair at one of its nodes only."""
    pair = near.select("node", "set_id", F.explode("partners").alias("partner"))
    both = [F.least("set_id", "partner").alias("a"), F.greatest("set_id", "partner").alias("b")]
    pair = pair.select("node", *both).groupBy("a", "b").agg(F.min("node").alias("node"))
    ends = pair.select("node", F.col("a").alias("set_id"), F.col("b").alias("partner")).unionByName(
        pair.select("node", F.col("b").alias("set_id"), F.lit(None).cast("long").alias("partner"))
    )
    # A node is bounded, so are its partners; nulls are not collected.
    return ends.groupBy("node", "set_id").agg(F.collect_list("partner").alias("partners"))


class _Links:
    """The component (`labels`) of every page that has a verified link so far."""

    def __init__(self, rows: DataFrame, classes: DataFrame, width: int, percent: int):
        self.rows, self.classes = rows, classes
        self.width, self.percent = width, percent
        self.labels = None

    def add(self, nodes: DataFrame, forest: bool, marks: DataFrame | None = None) -> None:
        """Compare the pages of each node (bounded in size) and verify the candidates.

        The text of a page goes once to each node where it has candidates, not once a pair.
        """
        near = copied(pin(_mixed(nodes, self.labels))).join(self.classes.select("set_id", "tokens"), "set_id")
        if not forest:
            none = F.array(*[F.lit(0).cast("long")] * TREES)
            near = near.join(marks, "set_id", "left").withColumn("marks", F.coalesce("marks", none))
        near = near.repartition("node").sortWithinPartitions("node", "set_id")
        near = near.mapInArrow(_compare(forest), "node long, set_id long, partners array<long>")
        near = pin(_once(near) if forest else near)
        # Not copied: a row may hold many partners.
        near = pin(near.join(self.classes.select("set_id", "digest"), "set_id"))
        needed = pin(near.select("digest").distinct())
        texts = self.rows.select("digest", "text").join(copied(needed), "digest", "left_semi")
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        near = near.join(texts, "digest").select("node", "set_id", "partners", "text")
        near = near.repartition("node").sortWithinPartitions("node")
        links = near.mapInArrow(_verify(self.width, self.percent), "a long, b long")
        if self.labels is not None:
            # Earlier links only count by their components.
            links = links.unionByName(self.labels.select(F.col("component").alias("a"), F.col("id").alias("b")))
        self.labels = pin(components(links))


def _blocks(small: int):
    """Number of blocks of half the size `small` that a large node is dealt to."""
    return F.ceil(2 * F.col("size") / F.lit(small)).cast("long")


def _with_leaders(large: DataFrame, small: int) -> DataFrame:
    """(node, set_id) of blocks: a page stands in one of the largest node that holds it, a few pages of a node in all of its blocks.

    A large group of near copies fills many nodes; once is enough to link it.
    """
    drawn = [F.min_by("set_id", F.xxhash64("node", "set_id", F.lit(i))) for i in range(LEADERS)]
    leaders = large.groupBy("node").agg(F.first("size").alias("size"), F.array_distinct(F.array(*drawn)).alias("sets"))
    leaders = leaders.select("node", "sets", F.explode(F.sequence(F.lit(0), _blocks(small) - 1)).alias("block"))
    leaders = leaders.select(F.xxhash64("node", "block").alias("node"), F.explode("sets").alias("set_id"))
    home = large.groupBy("set_id").agg(F.max(F.struct("size", "node")).alias("home")).select("set_id", "home.*")
    block = F.pmod(F.xxhash64("set_id"), _blocks(small))
    return home.select(F.xxhash64("node", block).alias("node"), "set_id").unionByName(leaders).distinct()


def _against(large: DataFrame, small: int) -> DataFrame:
    """Rows of nodes that stay large, for every two of their blocks: all pairs of such a node still meet, each once."""
    mine = F.pmod(F.xxhash64("set_id"), _blocks(small))
    dealt = large.withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), _blocks(small) - 1)))
    both = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))
    return dealt.select(both.alias("node"), "place", "set_id", F.expr("int(mine > other)").alias("side"))


def _parted(large: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Large mixed nodes with few pages outside their main component, and the others.

    The few meet all pages of their node, block by block; `label` is the component of a page so far.
    """
    counts = large.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
    counts = counts.agg(F.max_by("label", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    rows = pin(large.join(copied(pin(counts)), "node"))
    few_others = F.col("others") <= small // 2
    outside = F.col("label") != F.col("main")
    every = F.sequence(F.lit(-1).cast("long"), _blocks(small) - 1)
    mine = F.array(F.pmod(F.xxhash64("set_id"), _blocks(small)))
    block = F.explode(F.when(outside, every).otherwise(mine))
    side = outside.cast("int")
    lone = rows.where(few_others).select("node", block.alias("block"), "place", "set_id", side.alias("side"))
    # Block -1 holds the few alone.
    lone = lone.select(F.xxhash64("node", "block").alias("node"), "place", "set_id", "side")
    return lone, rows.where(~few_others).drop("main", "others", "label")


def _link(links: _Links, small: int, depth: int) -> None:
    """Grow the trees level by level and verify what meets in their nodes."""
    sets = links.classes.select("set_id", "tokens")
    place = "node long, place int, set_id long"
    children, leaves, lone, branched = sets.mapInArrow(_start, place), [], [], []
    for d in range(depth + 1):
        sizes = pin(children.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        rows = pin(children.join(copied(sizes), "node"))
        leaves.append(rows.where(F.col("size") <= small).select("node", "place", "set_id"))
        large = rows.where(F.col("size") > small)
        if large.isEmpty():
            large = None
            break
        # Near copies of one large group are linked here; a node with one component only has no more to find.
        links.add(_with_leaders(large, small), True)
        alone, large = _parted(_mixed(large, links.labels), small)
        lone.append(alone)
        if d < depth:
            branched.append(large.select("set_id", "place"))
        if large.isEmpty():
            large = None
            break
        if d < depth:
            children = pin(copied(large).join(sets, "set_id").mapInArrow(_branch, place))
    leaves = reduce(DataFrame.unionByName, leaves)
    for low, high in PORTIONS:
        links.add(leaves.where(F.expr("place div 64").between(low, high - 1)), True)
    nodes = reduce(DataFrame.unionByName, [leaves.withColumn("side", F.lit(0)), *lone])
    if large is not None:
        nodes = nodes.unionByName(_against(large, small))
    places = reduce(DataFrame.unionByName, branched) if branched else leaves.select("set_id", "place").limit(0)
    heap = F.expr("shiftleft(1L, place % 64)")
    marks = [F.bit_or(F.when(F.expr("place div 64") == t, heap).otherwise(0)) for t in range(TREES)]
    links.add(nodes, False, places.groupBy("set_id").agg(F.array(*marks).alias("marks")))


def near_copies(
    pages: DataFrame,
    width: int = SHINGLE,
    percent: int = PERCENT,
    small: int = SMALL,
    depth: int = DEPTH,
) -> DataFrame:
    """Components of pages whose sets of word shingles have a Jaccard similarity of `percent` hundredths or more.

    Pages with equal sets are one class from the start. A class has 64 minwise tokens. Each of 56 trees starts with a key of three
    tokens of its own: classes with the same values share a start node, so pages that have only a common line seldom meet.
    Nodes of at most `small` classes are compared exhaustively. The classes of a larger node are first linked in blocks that
    share a few of them. If few are outside the main component then, they are compared with all classes of the node; otherwise
    the node branches on: it chooses two tokens by its own hash, and classes with the same value go to the same child. What is still
    large after `depth` (5 at most) levels is compared block against block. A pair at the least similarity shares a start node of a tree
    with probability 0.42, and a node that far below with 0.37. All trees draw from the same tokens: summed over the number of equal ones, the
    trees and the least number below miss less than 2 such pairs in 100,000, and far fewer of closer ones. Pairs with half their tokens equal
    are verified on their full sets: first a spanning forest of each node of the first trees and of each large one, then, in all nodes that
    hold more than one component by then, all pairs between the components so far, each at the first node that holds it.

    pages: `doc_id`, `text`; other columns are not looked at. Words are lower-cased (ASCII) and parted by ASCII white
    space; a text of fewer words than `width` is one shingle. Null and blank texts have no shingle and no links.
    Returns one row per page: `doc_id`, `n_shingles`, `component_id` (smallest doc_id of the component, null ids aside) and
    `kept` (doc_id is component_id). Repeated rows of one doc_id share all values. No pages give no rows.
    """
    bound_batches(pages.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pages.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, digest long, n_shingles long, set_id long, tokens binary"
    sketches = pin(rows.mapInArrow(_sketch(width), schema))
    classes = sketches.where("n_shingles > 0").groupBy("set_id")
    classes = pin(
        classes.agg(F.min("digest").alias("digest"), F.first("tokens").alias("tokens"), F.min("doc_id").alias("least"))
    )
    links = _Links(rows, classes, width, percent)
    _link(links, small, depth)
    labels = links.labels
    joined = classes.join(copied(labels.withColumnRenamed("id", "set_id")), "set_id", "left")
    joined = joined.select("set_id", "least", F.coalesce("component", "set_id").alias("component"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = pin(joined.join(copied(least), "component").select("set_id", "component_id"))
    # Nearly every class is a page of its own: pages are joined by a shuffle, a class of many pages is split by skew.
    out = sketches.select("doc_id", "n_shingles", "set_id").join(copied(named), "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
