import pytest

from oracle import check
from tessergraph.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    check(spark, q.queries()[name], q.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert q.queries()[name](spark, sf).count() > 0


def test_entry_imports_without_the_optional_part(sf):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['tessergraph.llm'] = None; import __spark_entry__ as e; assert 'graph_nodes' in e.queries(); assert not any(k.startswith('op1_') for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent).returncode == 0
