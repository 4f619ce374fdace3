"""Tables of routes and points grow by explodes that Spark's estimates leave out: no estimate may send them through the driver."""

import re

import pytest

from tankline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["point_prices", "route_parts", "route_cost_cars", "route_answers", "route_answer_fields", "route_cost_overrides", "route_cost_register", "route_cost_sensor", "speed_sweep"])
def test_tables_of_routes_are_not_broadcast(spark, name):
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 60))  # as if all estimates were small
    try:
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert not re.findall(r"BroadcastHashJoin \[(?:request_id|point_id|level|hash_id#\d+, fuel_type)#?.*", plan)
    assert "REPARTITION_BY_NUM" in plan  # a small file isn't one task's work
