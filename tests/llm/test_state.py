import os

from cueweave.llm import _state
from cueweave.llm import pipeline as P
from cueweave.llm._state import CLEANUP, drop, scope, written

SF = "/root/testdata/sf0.001"


def test_written_tables_of_a_scope(spark):
    with scope() as made:
        a = written(spark.range(5), "a")
        with scope() as inner:
            b = written(a.selectExpr("id + 1 as id"), "b")
    assert made == [a] and inner == [b] and spark.conf.get(CLEANUP) == "false"
    drop(a)
    assert sorted(r.id for r in b.collect()) == [1, 2, 3, 4, 5] and not os.path.exists(a._cueweave_path.removeprefix("file://"))
    drop(b, a)


def test_the_pipeline_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(_state, "shared_dir", lambda _: f"file://{tmp_path}")
    out = P.run(spark, SF)
    assert out.count() > 0 and [d.rsplit("-", 1)[0] for d in os.listdir(tmp_path)] == ["mixing"]
