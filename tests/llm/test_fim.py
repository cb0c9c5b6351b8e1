"""Fill-in-the-middle against a unit-by-unit cutter, and round trips."""

import hashlib
import random
import re

from seriesmill.llm import fim
from seriesmill.llm.queries import QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
MARKS = ("<P>", "<S>", "<M>")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def listed(frame):
    return sorted((tuple(r[c] for c in "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()) for r in frame.collect()), key=str)


def test_all_documents(spark, sf_dir, rows_of):
    docs = rows_of("select doc_id, text from documents")
    found = listed(QUERIES["op11_fill_in_middle"](spark, sf_dir))
    assert found == sorted((plainly(*x) for x in docs), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_odd_rows(frame):
    rng = random.Random(5)
    docs = [(1, None), (2, ""), (3, "a<P>b"), (None, "no id here"), (None, "no id here"), (4, "\n\t"), (5, "é" * 9), (6, "one"), (7, "😀 x😀"), (8, "<S<M<P"), (9, "ab 1. " * 60_000)]
    docs += [(i, "".join(rng.choice("<PSM>aé \n") for _ in range(rng.randrange(12)))) for i in range(100, 400)]
    table = frame([(*d, 7, "x") for d in docs], "doc_id long, text string, n int, output string")
    out = fim.fill_in_middle(table)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    texts = out.select("doc_id", fim.restored(out["output"], out["form"]).alias("text"))
    assert sorted(map(tuple, texts.collect()), key=str) == sorted(((i, t or "") for i, t in docs), key=str)
    known = {str((i, t or "")): plainly(i, t) for i, t in docs}
    for r in out.withColumn("text", fim.restored(out["output"], out["form"])).collect():
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, sha(r.output), sha(r.text)) == known[str((r.doc_id, r.text))]
    assert fim.fill_in_middle(frame([], "doc_id long, text string")).collect() == []


def test_texts_go_to_python_once(spark, sf_dir):
    plan = QUERIES["op11_fill_in_middle"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
