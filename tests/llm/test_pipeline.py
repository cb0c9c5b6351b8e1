"""The pipeline's stages, one after the other, against brute force on each stage's own input."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_counts import check_mix
from test_near import brute, crowded_passage
from test_packing import brute_ratios, check

import corpus_pipeline
from seriesmill.llm import importance, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents and every stage's result, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(number))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 4
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_rejected_documents_go(spark, sf_dir, stages, rows_of):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in importance.importance(stages[0], labels).where("kept").collect()}
    rows = stages[1].collect()
    assert len(rows) == len(kept) and {r.doc_id for r in rows} == kept
    known = dict(rows_of("select doc_id, quality from labels"))
    assert sum(known[i] == 0 for i in kept if i in known) <= 0.1 * sum(q == 0 for q in known.values())
    assert sum(known[i] == 1 for i in kept if i in known) >= 0.95 * sum(q == 1 for q in known.values())


def test_every_label_counts(spark, tmp_path):
    """More labels than any bounded sample of them: all are in the model or in the cut that k is counted by."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    docs = [(i, " ".join(rng.choice(words[25 * (i % 4 > 0) :]) for _ in range(8))) for i in range(24_000)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in docs], "doc_id long, quality int")
    sample = importance.labelled_sample(labels, "doc_id", "quality", len(docs), importance.SEED).collect()
    expected = brute_ratios(docs, {r.label_id for r in sample if r.good and not r.held_out}, importance.BUCKETS, importance.SMOOTHING)
    held = [r for r in sample if r.held_out]
    cut = importance.best_cut(np.array([expected[r.label_id] for r in held]), np.array([r.good for r in held]))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = importance.importance(table, labels).collect()
    assert len(found) == len(docs) and all(abs(r.importance - expected[r.doc_id]) < 1e-9 for r in found)
    assert abs(importance.fit(table, labels).cut - cut) < 1e-9
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, table, str(tmp_path)).select("doc_id").collect()}
    assert len(kept) == sum(x >= cut for x in expected.values()) and kept == {r.doc_id for r in found if r.kept}


@pytest.mark.parametrize("seed", range(4))
def test_the_best_cut_of_a_table(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.gauss(good, 1), 9 if seed else 1), good) for good in [rng.random() < 0.3 for _ in range(300)]]
    if seed == 3:
        rows = [(key, True) for key, _ in rows]
    found = importance.best_cut_of(spark.createDataFrame([(float(k), g) for k, g in rows], "importance double, good boolean").repartition(5))
    if seed:
        assert found == importance.best_cut(np.array([k for k, _ in rows]), np.array([g for _, g in rows]))
    else:  # equal keys go together
        keys, bad, good = sorted({k for k, _ in rows}), *([k for k, g in rows if g == x] for x in (False, True))
        right = [sum(k < x for k in bad) / len(bad) + 1 - sum(k < x for k in good) / len(good) for x in keys]
        at = max(range(len(keys)), key=lambda i: (round(right[i], 12), -i))
        assert at and found == (keys[at - 1] + keys[at]) / 2


def test_one_document_of_each_class_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    rows = stages[2].collect()
    assert sorted(r.doc_id for r in rows) == sorted({c for c, _ in brute(before).values()})
    assert {(r.doc_id, r.text) for r in rows} <= set(before)


def test_near_copies_among_many_strangers_go(spark, frame):
    """Of 25 near copies of a passage that 1000 other documents have too, the passage alone stays."""
    docs = [(i, text, "a") for i, text in enumerate(crowded_passage(random.Random(6), 1000, 25))]
    kept = corpus_pipeline.keep_distinct(spark, frame(docs, "doc_id long, text string, source string"), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, *range(26, 1026)]


def test_sources_are_mixed(stages):
    before = [(r.doc_id, r.source, r.text) for r in stages[2].collect()]
    decided = mixing.mix(stages[2]).collect()
    check_mix(decided, before)
    words = Counter()
    for r in stages[3].collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert words == +Counter({r.doc_id: r.taken for r in decided})


def test_everything_is_packed(stages):
    check(stages[4].collect(), [len(WORD.findall(r.text)) for r in stages[3].collect()])


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == stages[4].columns
    count = lambda frame: Counter((r.doc_id, r.piece, r.length) for r in frame.collect())
    assert count(found) == count(stages[4])


def test_extra_columns_and_odd_rows(spark, frame, tmp_path):
    schema = "doc_id long, text string, source string, n_chars long, importance string, near_row int, row_id int, mix_size int"
    text = " ".join(f"word{i}" for i in range(40))
    docs = frame(
        [(1, text, "a", 1, "x", 1, 1, 1), (1, text, "a", 1, "x", 1, 1, 1), (2, None, None, 1, "x", 1, 1, 1), (None, "", "b", None, None, None, None, None)], schema
    )
    frame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 3:
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        if number == 1:
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2"]
    empty = frame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
