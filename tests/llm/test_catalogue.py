from siltstone.llm import catalogue
from tests.oracle import differences, tables


def test_sql_twins(spark, tiny):
    con = tables(tiny)
    for name, sql in catalogue.oracle_sql().items():
        assert differences(catalogue.queries()[name](spark, tiny), con, sql) is None


def test_every_problem_has_queries(spark, tiny):
    names = catalogue.queries()
    assert {n.split("_")[0] for n in names} == {f"p{i}" for i in range(1, 9)}
    for name in ("p1_groups", "p2_confidence", "p3_pieces", "p4_consensus", "p4_annotators", "p4_agreement", "p6_packing", "p7_mix", "p7_shares", "p7_temperature", "p8_canonical"):
        assert names[name](spark, tiny).count() > 0, name
