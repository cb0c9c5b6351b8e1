"""Packing and importance."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.llm import importance, packing
from seriesmill.llm.queries import QUERIES

LENGTHS = (4, 8, 16)


def cost(used, lengths, overhead):
    return sum(min(x for x in lengths if x >= u) + overhead for u in used)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40), st.integers(0, 3))
def test_pieces_fit_and_no_single_length_is_cheaper(sizes, overhead):
    sizes = sorted(sizes, reverse=True)
    bin_of, used = packing.pack_pieces(sizes, LENGTHS, overhead)
    filled = Counter()
    for size, number in zip(sizes, bin_of, strict=True):
        filled[number] += size
    assert [filled[i] for i in range(len(used))] == used and all(x <= 16 for x in used)
    for only in LENGTHS:
        # plain best fit, bin by bin
        rooms = []
        for size in sizes:
            fits = [i for i, (room, _) in enumerate(rooms) if room >= size]
            if fits:
                i = min(fits, key=lambda i: rooms[i][0])
                rooms[i] = rooms[i][0] - size, rooms[i][1] + size
            else:
                length = max(only, min(x for x in LENGTHS if x >= size))
                rooms.append((length - size, size))
        assert cost(used, LENGTHS, overhead) <= cost([u for _, u in rooms], LENGTHS, overhead)


def least_cost(sizes, lengths, overhead):
    """By trying all ways to put pieces together."""
    best = [float("inf")]

    def go(i, used):
        if i == len(sizes):
            best[0] = min(best[0], cost(used, lengths, overhead))
            return
        for at in range(len(used)):
            if used[at] + sizes[i] <= lengths[-1] and used[at] not in used[:at]:
                go(i + 1, [*used[:at], used[at] + sizes[i], *used[at + 1 :]])
        go(i + 1, [*used, sizes[i]])

    go(0, [])
    return best[0]


def test_packings_are_near_the_least_cost():
    rng = random.Random(4)
    shares = []
    for _ in range(150):
        sizes = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 7))), reverse=True)
        overhead = rng.randint(0, 3)
        _, used = packing.pack_pieces(sizes, LENGTHS, overhead)
        shares.append(cost(used, LENGTHS, overhead) / least_cost(sizes, LENGTHS, overhead))
    assert max(shares) <= 1.3 and np.mean(shares) <= 1.02 and np.mean([x == 1 for x in shares]) >= 0.85


def test_openings_choose_their_length():
    """Mixed sizes: bins of several lengths open, and half of the shards get cheaper than with any one length."""
    lengths, gained = packing.LENGTHS, 0
    rng = random.Random(6)
    for _ in range(20):
        sizes = sorted((rng.choice([rng.randint(400, 500), rng.randint(900, 1020), rng.randint(1100, 2400)]) for _ in range(60)), reverse=True)
        joint = packing.joint_fit(sizes, lengths, packing.OVERHEAD)[1]
        uniform = min(cost(packing.uniform_fit(sizes, x, lengths)[1], lengths, packing.OVERHEAD) for x in lengths)
        gained += cost(joint, lengths, packing.OVERHEAD) < uniform
        assert len({packing.fitted(u, lengths) for u in joint}) > 1 and sum(joint) == sum(sizes)
        assert cost(packing.pack_pieces(sizes, lengths, packing.OVERHEAD)[1], lengths, packing.OVERHEAD) == min(uniform, cost(joint, lengths, packing.OVERHEAD))
    assert gained >= 10


def test_rooms_are_filled_with_the_longest_pieces():
    left = packing.Remaining([7, 7, 3, 3, 3, 1])
    assert left.fill(16) == 7 + 7 + 1
    assert left.fill(20) == 7 + 7 + 3 + 3 and left.fill(2) == 1 and left.fill(0) == 0
    left.take(7)
    left.take(1)
    assert left.fill(16) == 7 + 9 and left.fill(2) == 0 and packing.Remaining([]).fill(9) == 0


def check(rows, sizes):
    """Pieces cover each document; bins are filled without gap or overlap, at the least length."""
    bins, words = defaultdict(list), defaultdict(list)
    for r in rows:
        words[r.row_id].append((r.start, r.length))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        assert (r.bin_id is None) == (r.length == 0)
    assert sorted(sum(n for _, n in parts) for parts in words.values()) == sorted(sizes)
    for parts in words.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.position):
            assert r.position == at
            at += r.length
        assert {r.bin_used for r in parts} == {at}
        assert {r.bin_length for r in parts} == {min(x for x in packing.LENGTHS if x >= at)}


def test_all_documents_are_packed(spark, sf_dir, rows_of):
    sizes = [len(packing_words(x)) for (x,) in rows_of("select text from documents")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.pack(docs).collect(), sizes)
    check(packing.pack(docs, shard_pieces=30).collect(), sizes)


def packing_words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_odd_documents(frame):
    rows = [(1, None, 0), (1, "", 0), (None, "a " * 9000, 0), (None, "a " * 9000, 0), (2, " \n", 0), (3, "b " * 4096, 1)]
    packed = packing.pack(frame(rows, "doc_id long, text string, bin_id int")).collect()
    check(packed, [0, 0, 9000, 9000, 0, 4096])
    assert packing.pack(frame([], "doc_id long, text string")).collect() == []


def test_importance_tells_quality(spark, sf_dir, rows_of):
    found = {r.doc_id: r for r in QUERIES["op7_importance"](spark, sf_dir).collect()}
    assert len(found) == rows_of("select count(*) from documents")[0][0]
    labels = dict(rows_of("select doc_id, quality from labels"))
    good = [found[i].kept for i, q in labels.items() if q == 1]
    bad = [found[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.1


def brute_ratios(docs, good, buckets, smoothing):
    raw, target = np.zeros(buckets), np.zeros(buckets)
    per = {}
    for i, text in docs:
        (found, _, _), *_ = importance.features([text], buckets)
        per[i] = found
        counts = np.bincount(found, minlength=buckets)
        raw += counts
        target += counts * (i in good)
    ratios = importance.log_ratios(raw, target, smoothing)
    return {i: ratios[x].sum() for i, x in per.items()}


def test_importance_is_the_sum_of_log_ratios(spark, frame):
    docs = [(i, ("good words here " if i % 3 else "bad!! junk## ") * (40 + i % 5)) for i in range(90)] + [(200, None), (201, ""), (None, "good words")]
    labels = [(i, int(i % 3 > 0), "x") for i in range(60)] + [(None, 1, "x"), (4, 1, "y"), (61, None, "x")]
    table = frame(docs, "doc_id long, text string")
    label_table = frame(labels, "doc_id long, quality int, text string")
    sample = importance.labelled_sample(label_table, "doc_id", "quality", 1000, importance.SEED).collect()
    trained = {r.label_id for r in sample if r.good and not r.held_out}
    expected = brute_ratios(docs, trained, importance.BUCKETS, importance.SMOOTHING)
    found = importance.importance(table, label_table).collect()
    assert len(found) == len(docs)
    for r in found:
        assert abs(r.importance - expected[r.doc_id]) < 1e-6
        if r.doc_id is not None and r.doc_id < 90:
            assert r.kept == (r.doc_id % 3 > 0)
    kept = importance.resampled(table.selectExpr("*", "1 as importance"), label_table)
    assert kept.columns == ["doc_id", "text", "importance"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}


TERM = re.compile(r"[^\W]+|[^\w\s]+")


def plain_model(docs, good):
    """Importance up to scale from a plain dictionary of words and word pairs: no buckets, no arrays."""

    def grams(text):
        words = TERM.findall((text or "").lower())
        return words + list(zip(words, words[1:], strict=False))

    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(grams(text))
        if i in good:
            target.update(grams(text))
    n, m, s = sum(raw.values()), sum(target.values()), importance.SMOOTHING
    ratio = {g: np.log((target[g] + s * c / n) / (m + s) / (c / n)) for g, c in raw.items()}
    return {i: sum(ratio[g] for g in grams(text)) for i, text in docs}


def test_importance_orders_documents_as_well_as_a_plain_model(spark, sf_dir, rows_of):
    """How often a good held-out document stands above a bad one."""
    docs = rows_of("select doc_id, text from documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = importance.labelled_sample(labels, "doc_id", "quality", importance.LABELLED_ROWS, importance.SEED).collect()
    plain = plain_model(docs, {r.label_id for r in sample if r.good and not r.held_out})
    found = {r.doc_id: r.importance for r in QUERIES["op7_importance"](spark, sf_dir).collect()}
    good = [r.label_id for r in sample if r.held_out and r.good]
    bad = [r.label_id for r in sample if r.held_out and not r.good]

    def right(model):
        return np.mean([model[x] > model[y] for x in good for y in bad])

    assert right(found) > 0.95 and right(found) >= right(plain) - 0.03


def test_exactly_k_documents_are_drawn(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = importance.fit(docs, labels)
    rows = importance.importance(docs, labels).collect()
    k = sum(r.importance >= model.cut for r in rows)
    in_order = sorted(rows, key=lambda r: (-r.sample_key, r.doc_id))
    assert 0 < k < len(rows) and [r.kept for r in in_order] == [i < k for i in range(len(rows))]
    assert {r.doc_id for r in importance.resampled(docs, labels).collect()} == {r.doc_id for r in in_order[:k]}


def test_ties_go_to_the_smaller_id(spark):
    model = importance.Resampler(np.zeros(8), 0.0, 1)
    order = {"low": F.col("low"), "no_id": F.col("no_id"), "id": F.col("id")}
    rows = [(-5, 0, 3), (-5, 0, 9), (-5, 1, 0), (-4, 0, 1), (-6, 1, 0)]
    table = spark.createDataFrame(rows, "low long, no_id long, id long")
    kept = {tuple(r) for r in table.where(importance.is_kept(order, (-5, 0, 9))).collect()}
    assert kept == {(-6, 1, 0), (-5, 0, 3), (-5, 0, 9)} and model.cut == 0.0
    assert table.where(importance.is_kept(order, None)).count() == 0


def test_importance_without_labels_or_rows(frame):
    docs = frame([(1, "a"), (2, None)], "doc_id long, text string")
    nothing = frame([], "doc_id long, quality int")
    assert [r.kept for r in importance.importance(docs, nothing).collect()] == [True, True]
    assert importance.importance(frame([], "doc_id long, text string"), nothing).collect() == []


def test_the_labelled_sample_is_bounded(frame):
    labels = frame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    assert importance.labelled_sample(labels, "doc_id", "quality", 100, 1).count() == 100


def test_best_cut():
    assert importance.best_cut(np.array([1.0, 2, 10, 12]), np.array([False, False, True, True])) == 6
    assert importance.best_cut(np.array([1.0]), np.array([True])) == -np.inf


def test_gumbel_noise_is_standard(spark):
    noise = np.array([r[0] for r in spark.range(20000).select(importance.gumbel_noise(F.col("id"))).collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.var() - np.pi**2 / 6) < 0.1
