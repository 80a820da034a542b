from pyspark.sql import functions as F

from shiftlens import queries
from shiftlens.plans import compare
from shiftlens.sources import table


def test_queries_apply_the_comparison_s_own_code(spark, monkeypatch):
    assert queries.fit_width is table.fit_width and queries.split_headers is compare.split_headers
    assert queries.width_pad(spark, "").count() == 4
    monkeypatch.setattr(queries, "fit_width", lambda parts, n: (table.fit_width(parts, n)[0], F.lit(False)))
    assert queries.width_pad(spark, "").count() == 5
    monkeypatch.setattr(queries, "split_headers", lambda old, new: ([], old, new))
    assert {r.role for r in queries.header_intersection(spark, "/root/testdata/sf0.001").collect()} == {"old_only", "new_only"}
