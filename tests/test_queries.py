"""Every registered query of the bill engine against its SQL, on the small tables."""

import os

import compare
import pytest

from tallyframe.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert compare.differences(df, con, queries.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_greedy_matching_against_plain_python(spark):
    from collections import defaultdict

    from tallyframe.functions.similarity import ratio
    from tallyframe.functions.scalars import normalised
    from tallyframe.plans import fixture

    gold, pred = fixture.gold(spark, SF), fixture.predicted(spark, SF)
    sides = []
    for df, at in ((gold, "gi"), (pred, "pi")):
        docs = defaultdict(list)
        for r in df.select("doc_id", at, normalised("item_name").alias("n"), "item_amount").collect():
            docs[r.doc_id].append((r[at], r.n, r.item_amount))
        sides.append(docs)
    want = set()
    for d, gs in sides[0].items():
        pairs = sorted(((ratio(g[1], p[1]), g[0], p[0]) for g in gs for p in sides[1][d] if ratio(g[1], p[1]) >= 0.8 and abs(g[2] - p[2]) <= max(0.01 * abs(g[2]), 0.01)), reverse=True)
        used_g, used_p = set(), set()
        for s, g, p in pairs:
            if g not in used_g and p not in used_p:
                used_g.add(g)
                used_p.add(p)
                want.add((d, g, p))
    got = {(r.doc_id, r.gi, r.pi) for r in queries.greedy_item_match(spark, SF).collect()}
    assert got == want


def test_entry_imports_without_the_training_data_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tallyframe"), tmp_path / "tallyframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
