from vicinia.llm.common import Workspace
from vicinia.llm.simhash import near_duplicates


def test_no_join_is_built_in_the_driver(spark, docs, words, monkeypatch):
    plans, save = [], Workspace.save

    def noted(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Workspace, "save", noted)
    text = words(1, 200)
    out = near_duplicates(docs([(k, text + " end" * (k % 3)) for k in range(12)]))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3
    assert not [p for p in plans if "BroadcastHashJoin" in p]
    assert out.count() == 12
