"""Archives read back, nearest neighbours against brute force."""

import base64
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from seriesmill.llm import common, onebit, warc
from seriesmill.llm.queries import QUERIES


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def check(rows, pages, min_bytes=0):
    groups = defaultdict(list)
    for page_id, html in pages:
        groups[html or ""].append(page_id)
    found = defaultdict(list)
    for r in rows:
        found[r.payload_digest].append(r)
    assert len(rows) == len(pages)
    for payload, ids in groups.items():
        own = found[digest(payload)]
        assert sorted(str(r.page_id) for r in own) == sorted(map(str, ids))
        assert {r.payload_bytes for r in own} == {len(payload.encode())}
        responses = [r for r in own if r.record_type == "response"]
        if len(payload.encode()) < min_bytes:
            assert len(responses) == len(own)
            continue
        (first,) = responses
        assert first.page_id == max((x for x in ids if x is not None), default=None) and first.refers_to is None
        for r in own:
            if r is not first:
                assert (r.record_type, r.refers_to) == ("revisit", first.page_id)


def test_all_pages(spark, sf_dir, rows_of):
    check(QUERIES["op8_warc_revisits"](spark, sf_dir).collect(), rows_of("select page_id, html from pages"))


PAGES = [(i, f"http://a/{i}", f"page {i % 7}") for i in range(60)] + [
    (100, None, None), (101, "http://x\r\nWARC-Type: evil", ""), (None, "u", "page 1"), (None, "u", "only null"), (102, "u: v", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (103, "u", "é🙂\x00\r\n"), (103, "u", "é🙂\x00\r\n"), (104, "u", "x" * 3_000_000), (105, "u", "x" * 3_000_000),
]


@pytest.mark.parametrize("min_bytes", [0, 7])
def test_odd_pages(spark, frame, min_bytes):
    path = common.new_path(spark, "test-warc")
    table = frame([(*p, "c") for p in PAGES], "page_id long, url string, html string, payload_digest string")
    records = warc.archived(table, path, min_bytes).collect()
    rows = [type("R", (), {**r.asDict(), "refers_to": r.refers_to_page}) for r in records]
    check(rows, [(i, html) for i, _, html in PAGES], min_bytes)
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == len(records)
    for r in records:
        if r.record_type == "revisit":
            assert r.payload is None and by_id[r.refers_to].payload_digest == r.payload_digest
        else:
            assert digest(r.payload) == r.payload_digest
    assert sorted(r.payload for r in records if r.record_type == "response" and r.page_id == 102) == [PAGES[64][2]]


def test_archives_are_bounded(spark, frame):
    path = common.new_path(spark, "test-warc")
    captured = warc.captures(frame([(i, "u", "p" * 1000 + str(i)) for i in range(400)], "page_id long, url string, html string"))
    warc.write_archives(captured, path, archive_bytes=50_000)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) >= 12 and max(f.length for f in files) < 50_000
    assert warc.read_archives(spark, path).count() == 400


def test_damaged_archives_are_refused():
    record = warc.record_text(type("R", (), dict(row_key="2:x", page_id="2", url="u", payload="abc", payload_bytes=3, payload_digest=digest("abc"), original_key=None, place=1)))
    data = (record + "\r\n").encode()
    assert [x["payload"] for x in warc.parse_archive(data * 2)] == ["abc", "abc"]
    for bad in (data[:-3], data.replace(b"abc", b"abd"), b"x" + data):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_no_pages(frame):
    assert warc.archived(frame([], "page_id long, url string, html string")).collect() == []


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, every, k):
    """Rows (id, vector); results per query row."""
    rows = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and usable(v)]
    out = []
    for n, i, v in rows:
        if i % every == 0:
            hits = sorted((-product(v, w), j) for m, j, w in rows if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_search_equals_brute_force(spark, sf_dir, rows_of):
    rows = rows_of("select vec_id, embedding from embeddings")
    expected = brute(rows, 20, 20)
    found = sorted(tuple(r) for r in QUERIES["op9_onebit_search"](spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    same = len({(q, v) for q, _, v, _ in expected} & {(q, v) for q, _, v, _ in found})
    assert len(found) == len(expected) and same >= 0.99 * len(expected)
    exact = {(q, v): s for q, _, v, s in brute(rows, 20, 10**6)}
    assert all(exact[q, v] == s for q, _, v, s in found)
    blocks = onebit.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), block_rows=100, query_rows=10)
    assert sorted(tuple(r) for r in blocks.collect()) == found


def test_odd_vectors(frame):
    rng = random.Random(1)
    vectors = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(80)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[3]) for i in range(30)] + [(20, vectors[5]), (20, vectors[5])]
    rows += [(300, None), (301, []), (302, [0.0] * 24), (303, [None] + [1.0] * 23), (304, [float("nan")] * 24), (305, [float("inf")] * 24), (None, vectors[0])]
    rows += [(400 + i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(9)] + [(500, [1.0]), (510, [2.0]), (520, [-1.0])]
    table = frame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, row_id int")
    found = sorted(tuple(r) for r in onebit.neighbours(table, 10, 8, epsilon=6.0).collect())
    assert found == brute(rows, 10, 8)
    assert onebit.neighbours(frame([], "vec_id long, embedding array<float>")).collect() == []
    alone = frame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert onebit.neighbours(alone).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    vectors, queries = rng.normal(size=(2000, 64)), rng.normal(size=(50, 64))
    estimate, error = onebit.bounds(*onebit.encode(vectors), queries, onebit.EPSILON)
    off = np.abs(estimate - queries @ vectors.T)
    assert (off <= error).mean() > 0.995 and np.abs((estimate - queries @ vectors.T).mean()) < 0.05


@pytest.mark.parametrize("n, most", [(2_000, 0.1), (16_000, 0.04)])
def test_few_candidates_are_reranked(n, most):
    """Vectors without any structure, the hardest case; no neighbour is lost but by the bound's chance."""
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    queries, own = vectors[:100], np.eye(100, n, dtype=bool)
    places, scores, reranked = onebit.best_in_block(*onebit.encode(vectors), vectors, queries, own, 20, onebit.EPSILON)
    exact = queries @ vectors.T
    exact[own] = -np.inf
    wanted = [set(np.argsort(-x)[:20]) for x in exact]
    assert np.mean([len(w & set(p)) / 20 for w, p in zip(wanted, places, strict=True)]) >= 0.995
    assert reranked / (100 * n) <= most


@pytest.mark.parametrize("dim", [1, 5, 64, 100])
def test_packed_counts_equal_plain_products(dim):
    """Estimates from packed words are those of the rounded query with the signs."""
    rng = np.random.default_rng(dim)
    vectors, queries = rng.normal(size=(30, dim)), rng.normal(size=(4, dim))
    codes, lengths, fits = onebit.encode(vectors)
    estimate, _ = onebit.bounds(codes, lengths, fits, queries, 1.0)
    plain = np.zeros((4, 30))
    for r in range(onebit.ROTATIONS):
        signs = np.where(vectors / lengths[:, None] @ onebit.rotation(dim, r) > 0, 1, -1)
        turned = queries @ onebit.rotation(dim, r)
        low, width = turned.min(axis=1, keepdims=True), np.ptp(turned, axis=1, keepdims=True)
        step = np.where(width == 0, 1, width / (2**onebit.PLANES - 1))
        rounded = low + step * np.rint((turned - low) / step)
        plain += rounded @ signs.T * lengths / fits[:, r] / np.sqrt(dim) / onebit.ROTATIONS
    assert np.allclose(estimate, plain, atol=1e-4)
