"""Fingerprints and likeness against sets of paragraphs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seriesmill.llm import iblt
from seriesmill.llm.queries import QUERIES


def paragraphs(text):
    parts = set()
    for line in (text or "").split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*", line)
        for i in range(0, len(words), iblt.PART_WORDS):
            parts.add("".join(words[i : i + iblt.PART_WORDS]).rstrip(" "))
    return parts


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def edited(text, other):
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def check(rows, docs):
    """docs: (id, text) in order, ids distinct."""
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(found) == len(docs)
    by_text = {}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        changed, r = edited(text, after), found[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(likeness(text, changed), abs=1e-12)
        assert r.near_next == pytest.approx(likeness(text, after), abs=1e-12)
        for t, mark in ((text, r.fingerprint), (changed, r.edited_fingerprint)):
            assert by_text.setdefault(t, mark) == mark
    different = {frozenset(paragraphs(t)): m for t, m in by_text.items()}
    assert len(set(different.values())) == len(different)


def test_all_documents(spark, sf_dir, rows_of):
    docs = rows_of("select doc_id, coalesce(text, '') from documents order by doc_id")
    rows = QUERIES["op3_fingerprints"](spark, sf_dir).collect()
    check(rows, docs)
    assert sum(r.near_edited for r in rows) > 2 * sum(r.near_next for r in rows)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(iblt.fingerprints(table, range_rows=9).collect(), docs)


def test_odd_texts(frame):
    texts = [None, "", " ", "é🙂x", "a\n\nb\n", "same line\n" * 50, "w " * 40000, "\n".join(f"line {i} {i * i}" for i in range(3000)), "one", "one"]
    docs = [(i * 10, x) for i, x in enumerate(texts)]
    table = frame([(*d, "r", 1) for d in docs], "doc_id long, text string, range string, tie int")
    check(iblt.fingerprints(table, range_rows=3).collect(), [(i, x or "") for i, x in docs])


def test_one_row_no_rows_and_repeated_ids(frame):
    schema = "doc_id long, text string"
    assert iblt.fingerprints(frame([], schema)).collect() == []
    check(iblt.fingerprints(frame([(5, "a b\nc d")], schema)).collect(), [(5, "a b\nc d")])
    rows = iblt.fingerprints(frame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], schema), range_rows=2).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in rows) == [("1", 1)] * 3 + [("None", 1)] * 2
    assert len({r.fingerprint for r in rows}) == 3


def test_one_line_texts_are_compared_in_parts_of_16_words(frame):
    words = [f"w{i}" for i in range(160)]
    changed = [*words[:85], "other", *words[86:]]
    docs = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:40]))]
    rows = {r.doc_id: r for r in iblt.fingerprints(frame(docs, "doc_id long, text string")).collect()}
    # ten parts each, one of them changed; then 3 parts, of which the first 2 are among the 10
    assert rows[1].near_next == pytest.approx(1 - 2 / 20)
    assert rows[2].near_next == pytest.approx(1 - 9 / 13)
    assert [rows[i].fingerprint.split(":")[0] for i in (1, 2, 3)] == ["10", "10", "3"]


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(2)
    rows = []
    for n in range(0, 60):
        common = [rng.getrandbits(63) for _ in range(30)]
        rows.append((common + [rng.getrandbits(63) - (1 << 62) for _ in range(n // 2)], common + [rng.getrandbits(63) for _ in range(n - n // 2)]))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>")
    cells = iblt.subtract(iblt.sketch(F.col("a")), iblt.sketch(F.col("b")))
    found = table.select("a", "b", iblt.peeled(cells).alias("p"), iblt.by_blocks(F.col("a"), F.col("b")).alias("n")).collect()
    failed = 0
    for r in found:
        a, b = set(r.a), set(r.b)
        assert r.n == len(a ^ b)
        if r.p is None:
            failed += 1
            assert len(a ^ b) > 4
        else:
            assert {(x.n, x.key) for x in r.p} == {(1, x) for x in a - b} | {(-1, x) for x in b - a}
    assert 20 < failed < 55  # small sketches hold few differences; larger ones do the rest


def test_texts_are_shuffled_once(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = iblt.fingerprints(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert plan.count("Exchange hashpartitioning(range") <= 2 and "SinglePartition" not in plan


def test_no_task_gathers_texts(spark, sf_dir, monkeypatch):
    """Nor in the steps that are written before."""
    plans = []
    plain = iblt.written
    monkeypatch.setattr(iblt, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, name))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digests", iblt.digests_of(F.col("text")))
    found = {r.doc_id: r.next_text for r in iblt.with_next(rows, 20).collect()}
    texts = sorted((r.doc_id, r.text) for r in rows.collect())
    assert found == {a[0]: b[1] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)}
    for plan in plans:
        for window in re.findall(r"^.*Window \[.*$", plan, re.M):
            assert "text" not in window and "digests" not in window
