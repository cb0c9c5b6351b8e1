"""Resampling towards a target against plain loops; ranks against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from seriesmill.llm import target_sampling
from seriesmill.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def buckets(text, n, longest=1):
    words = WORD.findall((text or "").translate(UPPER))
    runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(x.encode()) % n for x in runs], len(words)


def plainly(docs, target, n=10_000, longest=1, percent=10, least=20, seed="2024"):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text, n, longest)[0])
    for text in target:
        t.update(buckets(text, n, longest)[0])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found, words = buckets(text, n, longest)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append((doc_id, len(found), weight, score, words))
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(order) // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(order)]
    return sorted(out + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def listed(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, frame.collect()), key=str)


def test_all_documents(spark, sf_dir, rows_of):
    docs, target = rows_of("select doc_id, text from documents"), [x for x, in rows_of("select text from benchmark")]
    assert listed(QUERIES["op12_target_sampling"](spark, sf_dir)) == plainly(docs, target)


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(frame, longest):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "É", "ß1", "x-y", "", "\x00z", "İ"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(120)]
    docs += [(5, None), (6, ""), (None, "beta " * 25), (None, "beta " * 25), (7, "same " * 30), (7, "same " * 30), (2**62, "long " * 100_000)]
    target = ["alpha beta ALPHA", None, "é ß1"]
    table = frame([(*d, 1, "s") for d in docs], "doc_id long, text string, weight int, segment string")
    wanted = frame([(x,) for x in target], "text string")
    options = {"buckets": 50, "longest": longest, "percent": 60, "min_words": 10, "samples": 4}
    found = listed(target_sampling.resampled(table, wanted, **options))
    assert found == plainly(docs, target, 50, longest, 60, 10)
    empty = frame([], "doc_id long, text string")
    assert target_sampling.resampled(empty, wanted).collect() == []
    assert listed(target_sampling.resampled(table, empty, **options)) == plainly(docs, [], 50, longest, 60, 10)


@pytest.mark.parametrize("shape", ["random", "one key", "a third equal", "sorted", "few", "none"])
def test_ranks(spark, shape):
    rng = random.Random(1)
    n = {"few": 3, "none": 0}.get(shape, 5000)
    value = {"one key": lambda i: 7, "a third equal": lambda i: 7 if i % 3 == 0 else rng.randrange(-100, 100), "sorted": lambda i: i}.get(shape, lambda i: rng.randrange(-(10**9), 10**9))
    rows = [(value(i), i % 4) for i in range(n)]
    table = spark.createDataFrame(rows, "a long, b long").repartition(6)
    ranked = target_sampling.ranked(table, ["a", "b"], segment_rows=400)
    found = sorted((r["rank"], r.a, r.b) for r in ranked.collect())
    assert [(a, b) for _, a, b in found] == sorted(rows) and [x for x, _, _ in found] == list(range(1, n + 1))


def test_ranges_are_even_even_if_a_third_of_all_rows_are_equal(spark, monkeypatch):
    kept = {}
    plain = target_sampling.written
    monkeypatch.setattr(target_sampling, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    rows = [(7 if i % 3 == 0 else i % 1000, 0) for i in range(30_000)]
    target_sampling.ranked(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"], segment_rows=1500).count()
    sizes = [r["count"] for r in kept["sampling-merged"].groupBy("segment").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.5 * 1500
