"""Queries that SQL can express, next to their SQL, over whole tables; the pipeline stage by stage."""

import pytest

import corpus_pipeline
from keystrata.llm import queries
from tests.llm.test_similar import jaccard, shingles
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLES[name]) == 200


def test_pipeline_stages(spark):
    """Each stage keeps the columns, drops or changes only what its operator decides, and leaves the rest alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, SF), "test")
        assert after.columns == docs.columns
        gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
        if name == "simhash":
            # All copies but the least go, and nothing that shares little with what stays.
            texts = {r.doc_id: r.text for r in before.collect()}
            sets = {i: shingles(t) for i, t in texts.items()}
            least = {}
            for i in sorted(texts):
                least.setdefault(texts[i], i)
            assert {i for i, t in texts.items() if least[t] != i} <= gone
            assert all(max(jaccard(sets[i], sets[j]) for j in texts if j != i) >= 0.7 for i in gone)
        elif name == "decontamination":
            want = views(SF).sql(queries.ORACLES["op4_decontamination"] + " WHERE coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)").fetchall()
            kept = {r.doc_id for r in before.collect()}
            assert gone == {r[0] for r in want} & kept
        elif name == "secrets":
            assert not gone
            spans = {r[0] for r in views(SF).sql(queries.ORACLES["op1_secret_scans"]).fetchall() if r[5]}
            changed = {r.doc_id for r in before.exceptAll(after).collect()}
            assert changed == spans & {r.doc_id for r in before.collect()}
        before = after
    mix = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert mix.columns == [*docs.columns, "taken", "taken_rows"]
    kept = {r.doc_id: r.text for r in before.collect()}
    sizes = {i: len((t or "").split()) for i, t in kept.items()}
    rows = mix.collect()
    assert all(r.text == kept[r.doc_id] and 0 < r.taken <= 3 * sizes[r.doc_id] and r.taken_rows == 1 for r in rows)
    assert sum(r.taken for r in rows) == sum(sizes.values())
    ran = corpus_pipeline.run(spark, SF)
    assert ran.exceptAll(mix).isEmpty() and mix.exceptAll(ran).isEmpty()
