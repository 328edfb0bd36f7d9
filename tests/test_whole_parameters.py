from gaugeflow import plans
from gaugeflow.plans import models

SMALL = "/root/testdata/sf0.001"


def test_models_run_with_the_surveys_parameters(spark, monkeypatch):
    """24 steps of a sequence, all components of an embedding, 200 trees."""
    seen = {}

    def spy(module, name, note):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **b: (seen.update(note(out := f(*a, **b), a, b)), out)[1])

    spy(models.W, "pack_sequences", lambda out, a, b: {"steps": len(out.select("values").first()[0])})
    spy(models.K, "propagate", lambda out, a, b: {"columns": len(a[2])})
    monkeypatch.setattr(models.D, "isolation_scores", lambda train, df, features, trees=200: (seen.update(trees=trees), df.withColumn("score", models.F.lit(0.5)))[1])
    queries = plans.queries()
    assert queries["d12_neighbour_scores"](spark, SMALL).count() > 0
    queries["d10_isolation_scores"](spark, SMALL)
    assert queries["d11_reconstruction_score"](spark, SMALL).count() > 0 and seen.pop("steps") == 24
    queries["c9_sequence_score_evaluation"](spark, SMALL)
    assert seen == {"steps": 24, "columns": len(models.table(spark, SMALL, "embeddings").first()["embedding"]), "trees": 200}
