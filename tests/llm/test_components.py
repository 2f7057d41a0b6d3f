"""Connected components: results, and plans that stay small (the driver's memory grew with them)."""

from tessella.llm import shared


def test_hot_ids_long_paths_and_none(spark):
    star = [(0, i) for i in range(1, 1300)]
    path = [(i, i + 1) for i in range(5000, 5064)]
    links = spark.createDataFrame([*star, *path, (1299, 7000), (9000, 9000)], "a long, b long").repartition(3)
    found = {r.id: r.component_id for r in shared.components(links).collect()}
    assert found == {**{i: 0 for i in range(1300)}, 7000: 0, **{i: 5000 for i in range(5000, 5065)}}
    assert shared.components(links.where("a < 0")).count() == 0


def test_no_plan_holds_a_step_twice(spark, monkeypatch):
    joins = []

    def stash(df, name, write=shared.stash):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, name)

    monkeypatch.setattr(shared, "stash", stash)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 600)], "a long, b long")
    assert shared.components(links).where("component_id = 100").count() == 600
    assert max(joins) <= 6
