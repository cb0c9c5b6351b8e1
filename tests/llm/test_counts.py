"""Token counts against the tokenizer library, mixing against its definition."""

import re
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesmill.llm import bpe, common, mixing
from seriesmill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    return bpe.Counter(bpe.vocabulary_path())


def test_counts_equal_the_library(spark, sf_dir, rows_of, tokenizer):
    found = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    texts = rows_of("select doc_id, text from documents")
    assert len(found) == len(texts)
    for doc_id, text in texts:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert found[doc_id].asDict() == {"doc_id": doc_id, "n_bytes": len((text or "").encode()), "n_tokens": n, "over_limit": n > 512}


def test_counts_of_odd_texts(frame, tokenizer):
    texts = [None, "", " ", "  x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>" * 3, "\x1c\x1d a\x85b", "é" * 5000,
             "x" * 20000, "日本語 テスト", "don't I'LL we've", "a \t\n  b", "🙂🙃 👩‍👩‍👧", "١٢٣ ½ Ⅷ", "é", "\x00\x01"]
    rows = [(i, x, 7) for i, x in enumerate(texts * 2)]
    found = {r.doc_id: r.n_tokens for r in bpe.token_counts(frame(rows, "doc_id long, text string, n_tokens int")).collect()}
    assert found == {i: len(tokenizer.encode(x or "", add_special_tokens=False).ids) for i, x, _ in rows}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(tokenizer, counter, text):
    assert counter(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_no_rows_no_counts(frame):
    assert bpe.token_counts(frame([], "doc_id long, text string")).collect() == []


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_resharing(sizes: dict) -> dict:
    """Shares by weight; what is above three times a size is shared again among the others."""
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {name: Fraction(1 + i % 3) for i, name in enumerate(names)}
    target, open_names, left = {}, list(names), Fraction(sum(sizes.values()))
    while open_names:
        share = {x: left * weight[x] / sum(weight[y] for y in open_names) for x in open_names}
        full = [x for x in open_names if share[x] > 3 * sizes[x]]
        if not full:
            return {**target, **share}
        for x in full:
            target[x] = Fraction(3 * sizes[x])
            left -= target[x]
            open_names.remove(x)
    return target


def check_mix(rows, docs, block=mixing.BLOCK_WORDS, shards=1):
    sizes = Counter()
    for _, source, text in docs:
        sizes[source] += len(WORD.findall(text or ""))
    targets = targets_by_resharing(sizes)
    taken = Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(targets[r.source]), rel=1e-9, abs=1e-9)
        taken[r.source] += r.taken
    for source, size in sizes.items():
        assert abs(taken[source] - targets[source]) <= min(2 * block * shards, 3 * size)


def test_mix_of_all_documents(spark, sf_dir, rows_of):
    docs = rows_of("select doc_id, source, text from documents")
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(frame).collect()
    check_mix(rows, docs)
    size = {d[0]: len(WORD.findall(d[2] or "")) for d in docs}
    assert all(r.size == size[r.doc_id] for r in rows)
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    several = mixing.mix(frame, shard_rows=20).collect()
    check_mix(several, docs, shards=12)


def test_mix_of_odd_rows(frame):
    docs = [(i, f"s{i % 5}", "word " * (i % 40)) for i in range(300)]
    docs += [(None, "s1", "a b c"), (None, None, "x y"), (7, None, None), (7, "empty", ""), (7, "empty", None), (7, "s1", "q " * 5000)]
    rows = mixing.mix(frame([(*d, 1, 2) for d in docs], "doc_id long, source string, text string, size int, shard int")).collect()
    check_mix(rows, docs)
    assert mixing.mix(frame([], "doc_id long, source string, text string")).collect() == []
    empty = mixing.mix(frame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert all((r.size, r.taken, r.target) == (0, 0, 0) for r in empty)


def test_short_texts_over_many_shards_get_their_target(frame):
    docs = [(i, "short", "a b c d e") if i % 10 == 0 else (i, f"s{i % 2}", "word " * 40) for i in range(600)]
    docs += [(i, "brief", "a b c d e f g h i j k") for i in range(600, 640)]
    rows = mixing.mix(frame(docs, "doc_id long, source string, text string"), shard_rows=10).collect()
    # the tolerance of one shard, for all 64 together
    check_mix(rows, docs)


def test_tiny_sources_come_within_a_block_of_their_own(frame):
    docs = [(0, "a", "one two three four five six seven"), (1, "b", "x y z"), (2, "c", "p q")] + [(10 + i, "d", "word " * 100) for i in range(30)]
    rows = mixing.mix(frame(docs, "doc_id long, source string, text string")).collect()
    check_mix(rows, docs)
    found = {r.source: (r.source_size, r.target, sum(x.taken for x in rows if x.source == r.source)) for r in rows}
    for size, target, taken in found.values():
        blocks = max(1, round(size / mixing.BLOCK_WORDS))
        assert abs(taken - target) <= size / blocks
    assert found["a"] == (7, 21.0, 21)


def test_sql_holds_over_many_shards(spark, rows_of, sf_dir, monkeypatch):
    import duckdb

    from seriesmill.llm import oracles

    monkeypatch.setattr(mixing, "SHARD_ROWS", 30)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sorted(tuple(r) for r in mixing.mix(docs, shard_rows=30).select("doc_id", "size", "source_size", "target", "taken").collect())
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = sorted(engine.execute(oracles._mix()).fetchall())
    assert found == expected


def test_mixed_documents_of_clashing_names(frame):
    schema = "doc_id long, text string, source string, mix_row int, mix_parts int, mix_part int, mix_text int, _mix_row int, _mix_text string, row_id int"
    docs = frame([(i, "a b c d e", f"s{i % 2}", 1, 2, 3, 4, 5, "t", 6) for i in range(9)], schema)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r)[3:] for r in mixed.collect()} == {(1, 2, 3, 4, 5, "t", 6)}


def test_many_sources_are_ranked_and_levelled_in_ranges(spark):
    """Thousands of sources over many ranges: no window over all of them, targets by their definition."""
    sizes = [(None if i == 7 else f"s{i * 7919 % 3001:05d}", i * i % 977) for i in range(3000)]
    table = spark.createDataFrame(sizes, "source string, source_size long").repartition(5)
    targets = mixing.source_targets(table)
    assert "SinglePartition" not in targets._jdf.queryExecution().executedPlan().toString()
    found = {r.source: r for r in targets.collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    assert [found[s].source_rank for s, _ in order] == list(range(1, 3001))
    weight = {s: mixing.WEIGHTS[i % 3] for i, (s, _) in enumerate(order)}
    limit, left, still = {s: 3.0 * n for s, n in sizes}, float(sum(n for _, n in sizes)), set(weight)
    while True:
        level = left / sum(weight[s] for s in still)
        full = {s for s in still if limit[s] <= level * weight[s]}
        if not full:
            break
        left, still = left - sum(limit[s] for s in full), still - full
    for s, _ in sizes:
        assert abs(found[s].target - (level * weight[s] if s in still else limit[s])) < 1e-6


def test_sums_before_a_row(frame):
    rows = [(None if i % 3 == 0 else i % 3, i * 37 % 101, float(i)) for i in range(101)]
    found = common.with_sums_before(frame(rows, "kind int, at int, v double"), ["kind"], [F.col("at")], {"before": "v"}, "sums").collect()
    assert len(found) == 101
    for r in found:
        assert r.before == sum(v for kind, at, v in rows if kind == r.kind and at < r.at)


def test_quotas_go_to_the_highest_quotients(spark):
    votes = [(s, i, float(v)) for s in range(3) for i, v in enumerate([1, 5, 17, 3000, 40, 41, 900 * s, 0])]
    found = mixing.apportion(spark.createDataFrame(votes, "shard long, source_rank int, votes double"), 10).collect()
    for s in range(3):
        own = {i: v for shard, i, v in votes if shard == s}
        quota = Counter()
        for _ in range(round(sum(own.values()) / 10)):
            best = max(own, key=lambda i: (Fraction(own[i]) / (2 * quota[i] + 1), -i))
            quota[best] += 1
        assert {r.source_rank: r.quota for r in found if r.shard == s} == {i: quota[i] for i in own}


def test_mixed_documents_have_the_words_taken(frame):
    docs = [(i, f"s{i % 3}" if i % 11 else None, " ".join(f"w{i}x{j}" for j in range(i * 7 % 90)), 5, "row") for i in range(200)]
    table = frame(docs, "doc_id long, source string, text string, n_chars long, row_id string")
    taken = Counter({r.doc_id: r.taken for r in mixing.mix(table).collect()})
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    words = Counter()
    for r in mixed.collect():
        found = WORD.findall(r.text)
        assert found and all(x.startswith(f"w{r.doc_id}x") for x in found)
        words[r.doc_id] += len(found)
    assert words == +taken
