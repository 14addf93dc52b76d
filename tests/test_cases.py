"""The rules on literal rows give the rows that were worked out for them."""

from types import SimpleNamespace

import pytest

from tests.cases import CASES
from tests.expected_rows import ROWS


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, rows = ROWS[name]
    got = CASES[name](SimpleNamespace(spark=spark))
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_risks_need_two_drugs(spark):
    from millrace.operators.risks import cumulative_risks

    rows = [(1, "B", "4.8", "QT uzaması"), (1, "A", "4.4", "ARİTMİ, kanama"), (1, "A", "4.8", "aritmi"), (1, "C", "4.1", "aritmi"), (1, "C", "4.5", None), (1, None, "4.8", "kanama"), (1, "", "4.8", "kanama"), (2, "A", "4.8", "INR"), (2, "B", "4.8", "inr"), (2, "C", "4.3", "hematom")]
    got = {(r.q, r.category): (r.drugs, r.severity) for r in cumulative_risks(spark.createDataFrame(rows, "q int, name string, section string, text string"), "q").collect()}
    assert got == {(1, "kardiyak"): (["A", "B"], "dikkat"), (2, "hematolojik"): (["A", "B", "C"], "kritik")}
