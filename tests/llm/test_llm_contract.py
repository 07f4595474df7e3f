import pytest

pytest.importorskip("reelspan.llm")

from pathlib import Path

import reelspan
from reelspan.llm.queries import QUERIES
from reelspan.llm.sql import ORACLE_SQL


def test_names():
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 8, 9)} <= set(QUERIES) and "p7_containers" in QUERIES
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_nothing_else_imports_this_package():
    root = Path(reelspan.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "reelspan.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p5_found", "p6_found"])
def test_small_tables(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
