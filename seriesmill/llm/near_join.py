"""N-gram Jaccard self-join with a MinHash LSH forest.

1. Sign. Every whole text becomes its set of five-word shingles; texts with equal sets are one
   class of copies. A set is signed by `TREES` tries, each a sequence of `DEPTH` MinHash values.
2. Look up. The sequences of all tries are sorted, so sets with a common prefix stand next to each
   other and the neighbour is the set with the longest one. In every trie a set's prefix starts at
   full depth and is shortened until it meets a neighbour, but never below the depth at which two
   sets at the threshold meet in some trie with probability `RECALL`.
3. Estimate. Neighbours whose signatures agree in too few of all values (`MARGIN` deviations below
   the threshold) are no link. The other links are reduced to a forest in each task; sets that they
   connect form a cluster. Then sets go on past the members of their own cluster: where sets of
   different clusters share a prefix, one set of each is kept, and these are looked up again, until
   no new link is found. Rounds only save work: where they leave sets of different clusters with
   one prefix uncompared, the signatures of all of these are compared, cluster against cluster, in
   tiles of about `RUN_TILE` sets. So no two sets that share a prefix are missed, however many do.
4. Verify. A cluster is compared exactly, all sets with all, in tiles of about `TILE` sets; a tile
   pair is one bounded step that counts links per set and gives a forest of the links found: one
   link per set for a tile with itself, one for each two parts it joins for two tiles.
5. Classes are the components of verified links.

Result, one row per document: doc_id, class_id (smallest doc_id of the class) and n_links (other
documents with a Jaccard similarity at or above the threshold, copies included).

Scale: texts are shuffled once, in step 4 (only texts in clusters are kept after that join). Tries
are range-partitioned by prefix and set, so a prefix that a third of all sets have is spread over
tasks. Clusters are chains of similar sets only, not of all that meet in a trie. Memory is bounded
by a tile pair; the number of tile pairs of a cluster grows with the square of its different
texts, not of its copies, and its links with the number of texts. Where many clusters share one
prefix, as texts around a common passage do, comparing their signatures grows with the square of
their sets; a set's signature is shuffled once for each tile.

Defined results: words are split at ASCII white space and lower-cased; a text of fewer than five
words is one shingle; null, empty and blank texts are copies of each other; rows with the same id
are separate documents; a null id is never the class_id unless all ids of the class are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.common import free_names, named, written
from seriesmill.llm.components import Forest, components, forest
from seriesmill.llm.hashing import mixed, shingle_sets

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 10
RECALL = 0.999
MARGIN = 5.0
FURTHER = 8
TILE = 256
RUN_TILE = 2048
SEED = 7
MOST_ROUNDS = 20
VALUE_BYTES = 2


def recall(depth: int, trees: int, similarity: float) -> float:
    """Probability that two sets share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(trees: int = TREES, depth: int = DEPTH, similarity: float = THRESHOLD, target: float = RECALL) -> int:
    """The depth to which prefixes may be shortened: from full depth until the recall reaches the target."""
    while depth > 1 and recall(depth, trees, similarity) < target:
        depth -= 1
    return depth


def least_agreement(threshold: float, values: int, margin: float = MARGIN) -> float:
    """The share of agreeing values below which two sets are not at the threshold, but for `margin` deviations."""
    return threshold - margin * (threshold * (1 - threshold) / values) ** 0.5


class Signer:
    """The MinHash values of shingle sets, two bytes each, trie after trie."""

    def __init__(self, trees: int, depth: int, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.factor = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.term = random.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(shingles), 2048):
            some = shingles[start : start + 2048]
            np.minimum(out, (self.factor[:, None] * some[None, :] + self.term[:, None]).min(axis=1), out=out)
        return out

    def signature(self, shingles: np.ndarray) -> bytes:
        return mixed(self.minima(shingles)).astype(np.uint16).tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """A written table: doc_id, key of the shingle set, signature (empty for a set without shingles)."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, last = Signer(trees, depth), {}
        for rows in batches:
            keys, signatures = [], []
            for shingles in shingle_sets(rows["text"].tolist(), words):
                key = set_key(shingles)
                if key not in last:
                    if len(last) > 1000:
                        last.clear()
                    last[key] = signer.signature(shingles) if len(shingles) else b""
                keys.append(key)
                signatures.append(last[key])
            yield pd.DataFrame({"doc_id": rows["doc_id"], "key": keys, "signature": signatures})

    return written(docs.mapInPandas(signed, "doc_id long, key binary, signature binary"), "near-signed")


def trie_paths(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """Rows (path, node) from (node, signature): the trie's number and the set's values in it."""
    width = depth * VALUE_BYTES
    number = "unhex(lpad(hex(t), 4, '0'))"
    paths = F.expr(f"transform(sequence(0, {trees - 1}), t -> concat({number}, substring(signature, t * {width} + 1, {width})))")
    return sets.where(F.length("signature") > 0).select(F.explode(paths).alias("path"), "node")


def common_prefix(paths: np.ndarray, step: int) -> np.ndarray:
    """How many values each row's path has in common with that `step` rows before."""
    same = (paths[step:] == paths[:-step]).reshape(len(paths) - step, -1, VALUE_BYTES).all(axis=2)
    return np.cumprod(same, axis=1).sum(axis=1) - 1  # the first two bytes are the trie's number


def neighbours(paths: DataFrame, least: int, reach: int = 1) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): pairs (a < b) of sets at most `reach` places apart in a trie that share a prefix
    of `least` values or more; and the (path, node) rows of all sets that share one.

    Pairs over the border of two partitions are found among the first and last rows of all of them.
    """
    schema = "a long, b long, path binary, kind int"
    pair, shared, border = range(3)

    def given(kind: int, a, b=-1, path=None) -> pd.DataFrame:
        out = pd.DataFrame({"a": a, "b": b, "kind": kind})
        return out.assign(path=path).astype({"path": object})[["a", "b", "path", "kind"]]

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, begun = None, 0
        for rows in batches:
            if not len(rows):
                continue
            old = 0 if held is None else len(held)
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            path, node = rows["path"].to_numpy(), rows["node"].to_numpy()
            values = np.frombuffer(b"".join(path), np.uint8).reshape(len(rows), -1)
            meeting = np.zeros(len(rows), bool)
            for step in range(1, min(reach, len(rows) - 1) + 1):
                late = np.flatnonzero(common_prefix(values, step) >= least) + step
                if step == 1:
                    meeting[late], meeting[late - 1] = True, True
                late = late[late >= old]
                yield given(pair, node[late - step], node[late])
            yield given(shared, node[meeting], path=path[meeting])
            first = slice(old, old + max(reach - begun, 0))
            yield given(border, node[first], path=path[first])
            begun += len(rows) - old
            held = rows.iloc[-reach:]
        if held is not None:
            yield given(border, held["node"].to_numpy(), path=held["path"].to_numpy())

    dealt = paths.repartitionByRange("path", "node").sortWithinPartitions("path", "node")
    found = written(dealt.mapInPandas(linked, schema), "near-links")
    prefix = F.substring("path", 1, (least + 1) * VALUE_BYTES)
    edges = found.where(F.col("kind") == border).select("path", F.col("a").alias("node")).distinct()
    in_run = Window.partitionBy(prefix).orderBy("path", "node")
    before = F.array(*[F.lag("node", step).over(in_run) for step in range(1, reach + 1)])
    across = edges.select("path", "node", F.array_compact(before).alias("before"), (F.count(F.lit(1)).over(Window.partitionBy(prefix)) > 1).alias("meets"))
    across = written(across.where("meets"), "near-borders")
    pairs = found.where(F.col("kind") == pair).select("a", "b").union(across.select(F.explode("before").alias("a"), F.col("node").alias("b")))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = found.where(F.col("kind") == shared).select("path", F.col("a").alias("node")).union(across.select("path", "node"))
    return pairs, rows.distinct()


def likely_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose signatures agree in a share of `least` or more of their values;
    each task gives a forest of them."""
    signed = sets.select("node", "signature")
    both = pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("one")), "a")
    both = both.join(signed.select(F.col("node").alias("b"), F.col("signature").alias("other")), "b")

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links():
            for rows in batches:
                one, other = (np.frombuffer(b"".join(rows[x]), np.uint16).reshape(len(rows), -1) for x in ("one", "other"))
                kept = rows[(one == other).mean(axis=1) >= least] if len(rows) else rows
                yield kept["a"].to_numpy(), kept["b"].to_numpy()

        yield from forest(links())

    return both.select("a", "b", "one", "other").mapInPandas(agreeing, "a long, b long")


def in_tiles(rows: DataFrame, key: str, compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `compare` gives for every pair of tiles (i <= j) of a key, from rows (key, node, tiles, ...).

    The rows of a key are dealt to its number of tiles by node.
    """
    placed = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = placed.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = other.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("tiles", "other")
    keys = [key, "i", "j"]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows, one tile pair at a time."""
        held: list[pd.DataFrame] = []
        for rows in batches:
            for _, some in rows.groupby(keys, sort=False):
                if held and tuple(held[0][keys].iloc[0]) != tuple(some[keys].iloc[0]):
                    yield compare(pd.concat(held))
                    held = []
                held.append(some)
        if held:
            yield compare(pd.concat(held))

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(runs, schema)


def likely_between(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links (a, b) of clusters in a tile pair, no more than join them.

    Two clusters are linked where the signatures of a set of one and a set of the other agree in a
    share of `least` or more of their values.
    """
    rows = rows.sort_values("label", kind="stable")
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    one, other = rows[rows["tile"] == i], rows[rows["tile"] == j]
    joined, kept = Forest(), []
    if len(one) and len(other):
        ones, others = (np.frombuffer(b"".join(x["signature"]), np.uint16).reshape(len(x), -1) for x in (one, other))
        labels, width = other["label"].to_numpy(), others.shape[1]
        for label, values in zip(one["label"].tolist(), ones, strict=True):
            low, high = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            # in a tile with itself, clusters before this one have been compared with it
            for part in [slice(high, None)] if i == j else [slice(low), slice(high, None)]:
                near = labels[part][(others[part] == values).sum(axis=1, dtype=np.int32) / width >= least]
                kept += [(label, x) for x in np.unique(near).tolist() if joined.unite(label, x)]
    return pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)


def remaining_links(rows: DataFrame, sets: DataFrame, least: float, reach: int = FURTHER, tile: int = RUN_TILE) -> DataFrame:
    """Links (a, b) of clusters among all rows (node, label, prefix) with one prefix.

    Left out are only prefixes where the last round has compared all: those with one set of each
    cluster and no more clusters than `reach` places hold.
    """
    counts = rows.groupBy("prefix", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("prefix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    runs = counts.where(f"labels > 1 and (n > labels or labels > {reach + 1})")
    runs = written(runs.select("prefix", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "near-runs")
    signed = rows.select("prefix", "node", "label").join(runs, "prefix").join(sets.select("node", "signature"), "node")
    return in_tiles(signed, "prefix", lambda some: likely_between(some, least), "a long, b long")


def clusters(sets: DataFrame, trees: int, depth: int, threshold: float, target: float) -> DataFrame:
    """node, label: sets that links in the forest connect, directly or not.

    What the rounds find spares comparisons; the sets they leave apart are all compared at the end.
    """
    least, agreement = least_depth(trees, depth, threshold, target), least_agreement(threshold, trees * depth)
    pairs, met = neighbours(trie_paths(sets, trees, depth), least)
    tested = written(pairs, "near-pairs")
    links = written(likely_links(tested, sets, agreement), "near-likely")
    for step in range(MOST_ROUNDS):
        labels = components(links, f"near-clusters-{step}")
        label = F.coalesce("label", "node")
        rows = met.join(labels, "node", "left").select("path", "node", label.alias("label"), F.substring("path", 1, (least + 1) * VALUE_BYTES).alias("prefix"))
        kept = rows.groupBy("prefix", "label").agg(F.min(F.struct("path", "node")).alias("first"))
        several = kept.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix")
        open_rows = written(kept.join(several, "prefix", "left_semi").select("first.path", "first.node"), "near-open")
        if open_rows.isEmpty():
            return labels
        pairs, _ = neighbours(open_rows, least, FURTHER)
        fresh = written(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        found = written(likely_links(fresh, sets, agreement), "near-likely")
        if found.isEmpty():
            break
        tested, links = tested.union(fresh), written(links.union(found), "near-likely")
    rest = written(remaining_links(rows, sets, agreement), "near-rest")
    if found.isEmpty() and rest.isEmpty():
        return labels
    return components(links.union(rest), "near-clusters")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from blocks of the shingles that several sets have."""
    sizes = [len(x) for x in sets]
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    new = np.concatenate([[True], shingles[1:] != shingles[:-1]])
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    number, owner = number[shared], owner[shared]
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        low, high = np.searchsorted(number, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[low:high], number[low:high] - start] = 1
        out += block @ block.T
    return out.astype(np.int64)


def parts_of(similar: np.ndarray) -> np.ndarray:
    """The smallest row that each row is linked to, directly or not."""
    label = np.arange(len(similar))
    while True:
        best = np.minimum(label, np.where(similar, label[None, :], len(label)).min(axis=1, initial=len(label)))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def compared(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links per set of a tile pair, and peers: links that connect what is connected in the pair.

    In the pair of a tile with itself all its sets are compared, and a set's peer is the smallest
    one it is connected to. In another pair only sets of different tiles are; of the links between
    a part of one tile and a part of the other, one is kept, and no more than join them.
    """
    rows = rows.sort_values("node").reset_index(drop=True)
    sets = [np.asarray(x, np.int64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    both = intersections(sets)
    similar = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(similar, False)
    tile, nodes = rows["tile"].to_numpy(), rows["node"].to_numpy()
    same = tile[:, None] == tile[None, :]
    part = parts_of(similar & same)
    if rows["i"].iloc[0] == rows["j"].iloc[0]:
        return pd.DataFrame({"node": nodes, "peer": nodes[part], "links": similar @ rows["copies"].to_numpy()})
    similar &= ~same
    links = similar @ rows["copies"].to_numpy()
    one, other = np.nonzero(similar)
    between = {(part[x], part[y]): (nodes[x], nodes[y]) for x, y in zip(one, other, strict=True) if x < y}
    joined, peers = Forest(), []
    for parts, ends in between.items():
        if joined.unite(*parts):
            peers.append(ends)
    found = pd.DataFrame({"node": nodes, "peer": nodes, "links": links})
    return pd.concat([found, pd.DataFrame(peers, columns=["node", "peer"], dtype=np.int64).assign(links=0)])


def verify(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """node, peer, links from members (label, node, copies, shingles)."""
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = written(sizes.select("label", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "near-sizes")
    placed = members.join(sizes, "label").select("label", "node", "copies", "shingles", "tiles")
    return in_tiles(placed, "label", lambda rows: compared(rows, threshold), "node long, peer long, links long")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    target: float = RECALL,
    tile: int = TILE,
) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    docs = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    signed = sign(docs, words, trees, depth)
    sets = signed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "near-sets")
    labels = clusters(sets, trees, depth, threshold, target)
    clustered = labels.join(sets.select("node", "key", "first_id", "copies"), "node")
    clustered = written(clustered, "near-clustered").alias("c")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = list(shingle_sets(rows["text"].tolist(), words))
            same = np.array([set_key(x) == bytes(k) for x, k in zip(found, rows["key"], strict=True)], bool)
            out = rows[["label", "node", "copies"]].assign(shingles=[x.view(np.int64) for x in found])
            yield out[same]

    # the list grows with the documents: never broadcast it, and plan alike at every size
    clustered = clustered.hint("merge")
    texts = docs.alias("d").join(clustered, F.col("d.doc_id").eqNullSafe(F.col("c.first_id")))
    members = texts.select("label", "node", "copies", "key", "text").mapInPandas(
        shingled, "label long, node long, copies long, shingles array<bigint>"
    )
    # rows with the same id and text are one member
    verified = written(verify(written(members, "near-members").dropDuplicates(["label", "node"]), threshold, tile), "near-verified")
    classes = components(verified.select(F.col("node").alias("a"), F.col("peer").alias("b")), "near-classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    named_sets = sets.select("key", "first_id", "copies", "node").join(classes, "node", "left").join(links, "node", "left")
    named_sets = written(named_sets.withColumn("label", F.coalesce("label", "node")), "near-named")
    first = written(named_sets.groupBy("label").agg(F.min("first_id").alias("class_id")), "near-firsts")
    final = named_sets.join(first, "label").select(
        "key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.select("doc_id", "key").join(written(final, "near-final"), "key").select("doc_id", "class_id", "n_links")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest id.

    Of rows that share this id (or have none) and the class, any one stays. So the classes are
    worked out on rows that have numbers of their own, which a written copy keeps the same.
    """
    (number,) = free_names(docs, "near_row")
    kept = written(docs.withColumn(number, F.monotonically_increasing_id()), "near-docs")
    classes = near_classes(kept, number, text_col, **options)
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("row_id"))
    ids = kept.select(F.col(number).alias("row_id"), named(id_col).alias("doc_id"))
    first = ids.join(classes.select(F.col("doc_id").alias("row"), "class_id"), F.col("row_id") == F.col("row"))
    first = written(first.groupBy("class_id").agg(F.min(order)["row_id"].alias("_near_first")), "near-kept")
    # the list grows with the documents: never broadcast it
    first = first.hint("merge")
    return kept.join(first, kept[number] == first["_near_first"], "left_semi").drop(number)
