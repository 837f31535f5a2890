"""How the lines become bars."""

from leadwake.plans import bindings

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_out_once_and_narrow(spark, capsys):
    """One exchange by supplier and date, no partial aggregate before it, and none of the bars for the suppliers' names."""
    bindings.quotes(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert plan.index("HashAggregate") < plan.index("Exchange hashpartitioning") and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning"):]
