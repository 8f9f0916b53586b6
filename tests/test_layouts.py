"""What counts from one layout shuffle, and that runs that share edges send them once."""

import re

import pyspark.sql.functions as F
import pytest

from tests.test_plans import SF, final
from triflux.operators.graph import lay_out
from triflux.operators.triangles import estimate_by_colours
from triflux.plans import registry


def keys(df):
    return set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", final(df)))


def test_all_methods_start_from_one_layout(spark):
    counts = registry.QUERIES["triangles_by_method"](spark, SF)
    assert len(counts.collect()) == 4
    # No method makes edges canonical or finds degrees by itself.
    assert not [x for x in keys(counts) if re.match(r"(src|u|v|x|key)#", x)]


@pytest.mark.parametrize("colours", [1, 3])
def test_an_edge_is_sent_once_for_all_runs(spark, colours):
    ids = spark.range(60)
    ends = ids.select(F.col("id").alias("u")).crossJoin(ids.select((F.col("id") * 3 % 60).alias("v")))
    layout = lay_out(ends)
    runs = [(5, 7), (5, 7), (11, 3), (4567, 123)]
    found = estimate_by_colours(layout, colours, runs)
    single = [estimate_by_colours(layout, colours, [run]).first().estimate for run in runs]
    assert [r.estimate for r in found.orderBy("run").collect()] == single
    assert not [x for x in keys(found) if "mid#" in x and "run#" in x]
