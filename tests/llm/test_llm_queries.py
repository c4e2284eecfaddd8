"""Every query of the subpackage against its SQL, or for its shape, on the smallest data."""

import pytest
from compare import differences, views

from siftline.llm import queries

NAMES = sorted(queries.queries())
COLUMNS = {
    "p1_found": ["group_key", "severity", "confidence", "cwe", "detector_ids"], "p2_found": ["accepted_key", "inc_key", "accepted_in"], "p3_found": ["group_key", "adv_key"],
    "p5_found": ["group_key", "finding_key"], "p6_found": ["tbl", "row_key", "line_no"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    sql = queries.oracle_sql().get(name)
    if sql is None:
        df = queries.queries()[name](spark, small)
        assert df.count() > 0
    else:
        _, mine, theirs = differences(queries.queries()[name], sql, spark, views(small), small)
        assert not mine and not theirs
        df = queries.queries()[name](spark, small)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and df.count() == df.distinct().count()


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import siftline

    root = Path(siftline.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts[len(root.parts) :] and "siftline.llm" in p.read_text()]
