"""The values of a pair are looked up by bytes of its masks, not tested one by one."""

from pyspark.sql import functions as F

from spanledger.operators import standards


def test_values_of_a_pair_need_no_function_for_each_value(spark):
    names = [f"v{n:03d}" for n in range(150)]
    tokens = spark.createDataFrame([(s, v) for s in (1, 2, 3) for v in names[:: s + 1]] + [(3, "12"), (2, "annex-iv-2")], "subject int, token string")
    tables = {
        "characteristics": spark.createDataFrame([("s1", v) for v in names] + [("s2", v) for v in names[::5]], "standard_id string, characteristic string"),
        "evidence_characteristics": spark.createDataFrame([("s2", v) for v in names[::7]], "standard_id string, characteristic string"),
        "articles": spark.createDataFrame([("s1", "Article 12")], "standard_id string, article string"),
        "annex": spark.createDataFrame([("s2", "annex-iv-2")], "standard_id string, annex string"),
    }
    lists = standards.matched_value_lists(tokens, tables)
    own = {s: set(names[:: s + 1]) for s in (1, 2, 3)}
    expected = {(s, "s1"): sorted(own[s] | ({"Article 12"} if s == 3 else set())) for s in own}
    expected |= {(s, "s2"): sorted((own[s] & {*names[::5], *names[::7]}) | ({"annex-iv-2"} if s == 2 else set())) for s in own}
    assert {(r["subject"], r["standard_id"]): r["values"] for r in lists.collect()} == expected
    plan = lists.select(F.size("values"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan.split("Join")[0] and "from_json" not in plan
