"""Queries against their SQL, on the small tables."""

import pytest

from seriesmill.llm.oracles import ORACLES
from seriesmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, engine, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    result = engine.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    in_order = lambda rows: sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))
    ours = in_order([tuple(r[c] for c in columns) for r in frame.collect()])
    theirs = in_order([tuple(r[i] for i in at) for r in result.fetchall()])
    assert ours == theirs
