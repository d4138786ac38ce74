"""What the reviewer found in round 3, third pass."""

import re

from quillspan import catalogue
from quillspan.operators import spread

SF = "/root/testdata/sf0.001"


def test_joins_of_candidates_keep_their_tasks(spark, monkeypatch):
    """Rows dealt by number stay so in the joins with first times."""
    monkeypatch.setattr(spread, "ROWS", 500)
    plan = catalogue.QUERIES["prereq_confidence"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = {c: re.findall(rf"Exchange hashpartitioning\({c}#\d+L?, (\d+)\), (\w+)", plan) for c in ("src", "dst")}
    for found in dealt.values():
        assert len(found) == 2 and len({n for n, _ in found}) == 1 and {why for _, why in found} == {"REPARTITION_BY_NUM"} and int(found[0][0]) > 4


def test_frequencies_of_terms_are_counted_once(spark):
    """What is left to do when queries meet documents reads the documents for their number, length and terms, not for frequencies again."""
    plan = catalogue.QUERIES["bm25_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan
