"""The near join against all pairs, components against a walk, hashing against plain loops."""

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from seriesmill.llm import hashing, near_join
from seriesmill.llm.components import components
from seriesmill.llm.queries import QUERIES

SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = [x for x in SPLIT.split((text or "").lower()) if x]
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def walk(nodes, edges):
    beside = defaultdict(set)
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)
    label = {}
    for start in sorted(nodes):
        if start in label:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += beside[x]
    return label


def brute(docs, threshold=0.8):
    """doc_id -> (class, links), for distinct ids."""
    sets = {i: shingles(text) for i, text in docs}
    owners = defaultdict(set)
    for i, s in sets.items():
        for x in s or [()]:
            owners[x].add(i)
    pairs = set()
    for i, s in sets.items():
        for j in set().union(*(owners[x] for x in s or [()])) - {i}:
            both, either = len(s & sets[j]), len(s | sets[j])
            if s == sets[j] or both >= threshold * either:
                pairs.add((min(i, j), max(i, j)))
    label = walk(sets, pairs)
    links = defaultdict(int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return {i: (label[i], links[i]) for i in sets}


def test_all_documents(spark, sf_dir, rows_of):
    docs = rows_of("select doc_id, text from documents")
    found = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op5_near_join"](spark, sf_dir).collect()}
    assert found == brute(docs)
    assert len({x for x, _ in found.values()}) < len(docs)


def near_copies(count, rng, words=60, changes=2):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_large_groups_over_several_tiles(spark):
    rng = random.Random(3)
    texts = near_copies(150, rng) + near_copies(40, rng, 200, 6) + ["same text again and again here"] * 60
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(50)]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    expected = brute(docs)
    found = near_join.near_classes(table, trees=64, tile=20).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == expected
    kept = near_join.distinct_documents(table.selectExpr("*", "'z' as near_row", "1 as label"), trees=64, tile=20)
    assert kept.columns == ["doc_id", "text", "near_row", "label"]
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in expected.values()}


def test_odd_rows(frame):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (None, "one two"), (None, "lonely words"),
            (7, "x " * 30000), (7, "y z " * 200), (8, "Y z " * 200)]
    table = frame([(*d, 1) for d in docs], "doc_id long, text string, class_id int")
    found = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_join.near_classes(table).collect()), key=str)
    assert found == sorted(
        [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 2), (5, 4, 2), (6, 6, 0), (None, 4, 2), (None, None, 0), (7, 7, 0), (7, 7, 1), (8, 7, 1)], key=str
    )
    assert len(near_join.distinct_documents(table).collect()) == 6
    empty = frame([], "doc_id long, text string")
    assert near_join.near_classes(empty).collect() == [] and near_join.distinct_documents(empty).collect() == []


def test_prefixes_shorten_until_the_recall_is_reached():
    depth = near_join.least_depth()
    assert near_join.recall(depth, near_join.TREES, 0.8) >= near_join.RECALL > near_join.recall(depth + 1, near_join.TREES, 0.8)


@pytest.mark.parametrize("reach", [1, 3])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_neighbours_in_a_trie(spark, reach, batch):
    """Against a plain sort: pairs at most `reach` places apart, and all rows that share a prefix."""
    rng = random.Random(reach)
    word = lambda: rng.choice([b"\0\1", b"\0\2", b"\3\0"])
    rows = [(rng.choice([b"\0\0", b"\0\1"]) + b"".join(word() for _ in range(4)), node) for node in range(400)]
    rows += [(b"\0\7" + b"zzzzzzzz", 1000 + i) for i in range(150)] + [(b"\0\5" + bytes([i]) * 8, 2000 + i) for i in range(50)]
    table = spark.createDataFrame(rows, "path binary, node long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        pairs, met = near_join.neighbours(table, 3, reach)
        found, shared = {(r.a, r.b) for r in pairs.collect()}, {(bytes(r.path), r.node) for r in met.collect()}
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows.sort()
    near = {tuple(sorted((rows[i - k][1], rows[i][1]))) for k in range(1, reach + 1) for i in range(k, len(rows)) if rows[i - k][0][:8] == rows[i][0][:8]}
    assert near <= found and len(found - near) <= 60 * reach * reach
    prefix = dict(rows)
    assert all(x[:8] in {p[:8] for p in prefix} for x, _ in shared)
    runs = defaultdict(list)
    for p, n in rows:
        runs[p[:8]].append((p, n))
    assert shared == {x for run in runs.values() if len(run) > 1 for x in run}


def test_links_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    """Production parameters: edges per set stay the same while a group grows, and no copy is missed."""
    kept = []
    plain = near_join.components
    monkeypatch.setattr(near_join, "components", lambda edges, name: kept.append((name, edges.where("a <> b").count())) or plain(edges, name))
    per_set = []
    for n in (256, 1024):
        kept.clear()
        docs = list(enumerate(near_copies(n, random.Random(n), 80, 2)))
        found = near_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
        different = len({shingles(t) for _, t in docs})
        assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute(docs)
        per_set.append(sum(count for _, count in kept) / different)
    assert per_set[1] <= 1.3 * per_set[0] and per_set[1] < 20


def test_recall_at_the_threshold(spark):
    """Lone pairs just above the threshold, with production parameters."""
    rng = random.Random(12)
    docs, wanted = [], 0
    for i in range(300):
        base = [f"w{rng.randrange(10**9)}" for _ in range(49 + i % 50)]
        other = list(base)
        other[-1 - i % 3 :] = [f"x{rng.randrange(10**9)}" for _ in range(1 + i % 3)]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    expected = brute(docs)
    wanted = sum(links for _, links in expected.values())
    found = near_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert wanted == 600 and sum(r.n_links for r in found) >= 0.99 * wanted


def test_common_passages_make_no_clusters(spark, monkeypatch):
    """Texts that share half their words, all with all, are not chained before they are verified."""
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    docs = [(i, shared + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(40))) for i in range(400)]
    sizes = {}
    plain = near_join.verify
    monkeypatch.setattr(near_join, "verify", lambda members, *how: sizes.update(members=members.count()) or plain(members, *how))
    found = near_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute(docs)
    assert sizes["members"] < 20


def crowded_passage(rng, strangers, copies):
    """A passage alone (id 0), texts that are near it (the next ids) and strangers that have it too, none near another."""
    passage = [f"s{i}" for i in range(64)]
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    return [" ".join(passage)] + [" ".join(passage + own(14)) for _ in range(copies)] + [" ".join(passage + own(20)) for _ in range(strangers)]


def test_copies_among_many_strangers_with_one_passage(spark):
    """Production parameters: hundreds of sets of other clusters lie between near copies in every trie."""
    docs = list(enumerate(crowded_passage(random.Random(4), 1000, 25)))
    found = near_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    expected = {i: (0, 1) if i <= 25 else (i, 0) for i, _ in docs} | {0: (0, 25)}
    assert brute(docs[:60]) == {i: expected[i] for i in range(60)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == expected


TREES, DEPTH, LEAST = 4, 5, 3


def crowded_signatures(rng, groups):
    """Signatures that share prefixes in the first trie, in groups, and are near others far away in it."""
    out = []
    for group, size in enumerate(groups):
        bases = [rng.integers(1, 60000, TREES * DEPTH) for _ in range(1 + size // 3)]
        for node in range(size):
            values = bases[rng.integers(len(bases))].copy()
            values[:LEAST] = group
            values[LEAST:DEPTH] = rng.integers(1, 60000, DEPTH - LEAST)
            for trie in range(1, TREES):  # no prefix in common in the other tries
                values[trie * DEPTH] = rng.integers(1, 60000)
            for at in rng.integers(DEPTH, TREES * DEPTH, rng.integers(3)):
                values[at] = rng.integers(1, 60000)
            out.append(values.astype(np.uint16))
    return [out[i] for i in rng.permutation(len(out))]


def test_clusters_hold_all_likely_links(spark, monkeypatch):
    """Against all pairs that share a prefix, with rounds that do not come to their end, and in tiles of several sizes."""
    threshold, target = 0.8, near_join.recall(LEAST, TREES, 0.8)
    monkeypatch.setattr(near_join, "least_agreement", lambda *_: 0.55)
    assert near_join.least_depth(TREES, DEPTH, threshold, target) == LEAST
    signatures = crowded_signatures(np.random.default_rng(5), [70, 30, 12, 2, 3])
    pairs = set()
    for a, one in enumerate(signatures):
        for b, other in enumerate(signatures[:a]):
            meet = any((one[t : t + LEAST] == other[t : t + LEAST]).all() for t in range(0, TREES * DEPTH, DEPTH))
            if meet and (one == other).mean() >= 0.55:
                pairs.add((b, a))
    expected = {x: label for x, label in walk(range(len(signatures)), pairs).items() if any(x in p for p in pairs)}
    assert 20 < len(set(expected.values())) < len(expected)
    sets = spark.createDataFrame([(i, x.astype("<u2").tobytes()) for i, x in enumerate(signatures)], "node long, signature binary").repartition(3)
    plain = near_join.remaining_links
    for rounds, tile in ((20, 2048), (1, 7)):
        monkeypatch.setattr(near_join, "MOST_ROUNDS", rounds)
        monkeypatch.setattr(near_join, "remaining_links", lambda *rows, tile=tile: plain(*rows, tile=tile))
        found = {r.node: r.label for r in near_join.clusters(sets, TREES, DEPTH, threshold, target).collect()}
        assert found == expected


def test_likely_links_between_clusters_of_a_tile_pair():
    one, other, lone = (np.full(10, x, np.uint16) for x in (1, 2, 3))
    half = np.where(np.arange(10) < 6, one, other).astype(np.uint16)
    rows = pd.DataFrame({"label": [5, 5, 7, 9, 7], "node": range(5), "tile": [0, 1, 1, 0, 0], "signature": [x.tobytes() for x in (other, one, half, lone, lone)]})
    within = near_join.likely_between(rows[rows["tile"] == 0].assign(i=0, j=0), 0.6)
    assert within.values.tolist() == [[7, 9]]
    assert near_join.likely_between(rows.assign(i=0, j=1), 0.6).values.tolist() == []
    assert near_join.likely_between(rows.assign(i=1, j=1), 0.6).values.tolist() == [[5, 7]]
    assert near_join.likely_between(rows.assign(i=0, j=1), 0.4).values.tolist() == [[5, 7]]
    assert near_join.likely_between(rows.assign(i=0, j=2), 0.4).empty


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(200))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range([20, 90, 150, 0][seed])]
    if seed == 1:
        edges += [(i, i + 1) for i in range(100, 160)]
    table = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in components(table).collect()}
    label = walk(nodes, edges)
    assert found == {x: label[x] for a, b in edges if a != b for x in (a, b)}


def test_shingle_sets_equal_plain_ones():
    rng = random.Random(1)
    texts = [None, "", "a", "a b c d", "É è  ü\n x y z"] + [" ".join(rng.choice("ab c dé \n") * rng.randrange(3) for _ in range(40)) for _ in range(50)]
    found = list(hashing.shingle_sets(texts * 2, 5))
    known = {}
    for text, hashes in zip(texts * 2, found, strict=True):
        assert len(hashes) == len(shingles(text))
        assert known.setdefault(shingles(text), tuple(hashes)) == tuple(hashes)
    assert len(set(known.values())) == len(known)


def test_words_may_be_cut_at_marks():
    hashes, offsets = hashing.word_hashes(["ab!! c", "!! AB", "", "c\n"], split_marks=True)
    assert offsets.tolist() == [0, 3, 5, 5, 6]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and hashes[2] == hashes[5] and len(set(hashes)) == 3


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (0, 1, 30, 40, 50)]
    found = near_join.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or found[i, j] == len(np.intersect1d(a, b))


def test_links_within_and_between_tiles():
    sets = [np.arange(20), np.arange(1, 21), np.arange(100, 120), np.arange(2, 22)]
    rows = pd.DataFrame({"node": [1, 2, 3, 4], "copies": [1, 2, 1, 5], "shingles": sets, "tile": [0, 0, 0, 1]})
    within = near_join.compared(rows[rows["tile"] == 0].assign(i=0, j=0), 0.8)
    assert within.values.tolist() == [[1, 1, 2], [2, 1, 1], [3, 3, 0]]
    between = near_join.compared(rows.assign(i=0, j=1), 0.8)
    # the two parts of a tile that a set of the other is like are one part already: one link joins them
    assert between.values.tolist() in ([[1, 1, 5], [2, 2, 5], [3, 3, 0], [4, 4, 3], [1, 4, 0]], [[1, 1, 5], [2, 2, 5], [3, 3, 0], [4, 4, 3], [2, 4, 0]])
