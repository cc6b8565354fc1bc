"""Every query of the subpackage against its SQL in DuckDB, on the smallest data; rows only where there is none."""

import pytest

from corrobora.llm import queries as llm
from tests.test_queries import DATA, compare, duck, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, llm.queries()[name], llm.oracle_sql().get(name))


def test_columns(spark):
    want = {
        "p1_found": ["ats_record_id", "roster_record_id"], "p4_found": ["record_id", "field_name", "pos", "canonical"], "p5_found": ["record_id", "group_id"],
        "p6_found": ["cluster_id", "field_path", "record_id", "order_index"], "p7_found": ["file_name", "change_kind", "field_name", "new_name"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"],
    }
    for name in ("p4_found", "p6_found", "p8_ids"):
        assert llm.queries()[name](spark, DATA).columns == want[name]
