"""The queries of this package that have SQL against it, the others for their columns, on the smallest tables."""

import pytest
from conftest import SMALL, same

from lorekeep.llm.queries import QUERIES, SQL

COLUMNS = {"p2_found": ["table_name", "id_a", "id_b"], "p3_found": ["session_id", "turn", "entry_id"], "p4_found": ["id_a", "id_b"], "p5_found": ["cluster_id", "episode_id"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        same(spark, duck, QUERIES[name], SQL[name])
    df = QUERIES[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0
