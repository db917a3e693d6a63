"""Tasks grow in number with a table, not in size."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from talkmill import tables
from talkmill.plans import mapping as M

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["co_attendance", "people_listing", "user_folded", "withheld_owners", "profile_sections", "relationship_map", "tag_frequency"])
def test_results_do_not_depend_on_the_tasks(spark, monkeypatch, name):
    """With many small tasks the rows are the same, and items are exchanged by a number that follows from the table."""
    shown = lambda df: sorted(map(str, df.collect()))
    want = shown(queries()[name](spark, SF))
    monkeypatch.setattr(M, "EACH", 300)
    n = M.parts(spark, SF)
    out = queries()[name](spark, SF)
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and f", {n})" in out._jdf.queryExecution().executedPlan().toString()
    assert shown(out) == want


def test_a_task_for_each_so_many_rows(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.tasks(spark, str(tmp_path), "t", 10) == 100 and tables.tasks(spark, str(tmp_path), "t", 1000) is None
    rows = tables.dealt(tables.load(spark, str(tmp_path), "t"), 100, "id")
    assert rows.rdd.getNumPartitions() == 100 and rows.agg(F.sum("id")).first()[0] == 499_500


def test_hypotheses_are_not_exchanged(spark, tmp_path):
    """Turns are exchanged, the hypotheses made of them are not; two turns of one number are replayed together, in order."""
    rows = [(1, 0, "a b c d e f"), (1, 1, ""), (1, 2, None), (None, 1, "a b"), (2, 5, "a b c d"), (2, 5, "a b c d x y z")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries()["partial_gate"](spark, str(tmp_path))
    assert sorted(map(tuple, out.where("utterance = 1000").collect())) == [(1000, 90, 1, 1, 1), (1000, 270, 2, 5, 1), (1000, 450, 3, 9, 1)]
    assert {r.utterance for r in out.collect()} == {1000, 2005}
    single = out._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[1]
    assert single.index("posexplode") < single.index("Exchange")  # from the top: below the replay hypotheses come first, then the exchange
