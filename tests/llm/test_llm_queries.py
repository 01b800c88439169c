import os

import duckdb
import pytest

from bindery.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_texts_are_cut_once(spark, data):
    plan = Q.p1_found(spark, data)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") == 3  # one for each field


def test_one_model_for_all_queries(spark, data, monkeypatch):
    from bindery.llm import abuse

    made = []
    fit = abuse.fit
    monkeypatch.setattr(abuse, "fit", lambda sample: made.append(1) or fit(sample))
    folder = data + "/."  # a folder that no other test has read
    assert Q.p9_found(spark, folder).count() == Q.p9_scores(spark, folder).where("abusive").count()
    assert Q.p9_rates(spark, folder).count() > 0 and len(made) == 1


def test_found_columns(spark, data):
    want = {
        "p1_found": ["field", "row_key"],
        "p4_found": ["tab", "row_key", "line_no", "kind"],
        "p6_found": ["page_id", "field", "line_no"],
        "p9_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = Q.QUERIES[name](spark, data)
        assert df.columns == columns and df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{data}/{f}')")
    want = con.execute(Q.SQL[name]).df()
    got = Q.QUERIES[name](spark, data).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_percentiles_count_every_call_once(spark, data):
    import numpy as np
    import pandas as pd

    m = pd.read_parquet(f"{data}/metric.parquet").drop_duplicates("_docid")
    m["provider"], m["stage"] = m.provider.fillna(""), m.stage.fillna("")
    got = Q.p3_percentiles(spark, data).where("day is null").toPandas()
    assert got.groupby("measure").n.sum().to_dict() == {"cost_usd": len(m), "execution_seconds": len(m)}
    for r in got.itertuples():
        x = np.sort(m[(m.provider == r.provider) & (m.stage == r.stage)][r.measure].fillna(0).to_numpy())
        assert len(x) == r.n
        if r.n < 384:
            assert [r.p50, r.p90, r.p95, r.p99] == [x[int(np.ceil(p * r.n)) - 1] for p in (0.5, 0.9, 0.95, 0.99)]
    files = Q.p3_file_sketches(spark, data)
    from bindery.llm.quantiles import read_quantiles

    assert sum(r["n"] for r in read_quantiles(files, [0.5]).collect()) == 2 * len(m)


def test_containers_and_shares(spark, data):
    packed = Q.p7_packed(spark, data).toPandas()
    fill = packed.groupby("container").part_size.sum()
    assert fill.max() <= Q.CAPACITY and set(packed[packed.part > 1].doc_id) <= set(packed[packed.tokens > Q.CAPACITY].doc_id)
    assert packed.groupby("doc_id").part_size.sum().to_dict() == packed.groupby("doc_id").tokens.first().to_dict()
    shares = Q.p8_shares(spark, data).toPandas()
    assert abs(shares.actual_share.sum() - 1) < 1e-4 and (shares.most_repeats <= shares.max_repeats).all()


def test_pages_without_their_furniture(spark, data):
    found = {(r["page_id"], r["field"], r["line_no"]) for r in Q.p6_found(spark, data).collect()}
    before = {r["page"]: r for r in Q._pages(spark, data).collect()}
    for r in Q.p6_clean(spark, data).collect():
        for field in Q.FIELDS:
            text = before[r["page_id"]][field]
            if text is not None:
                kept = [x for i, x in enumerate(text.split("\n"), 1) if (r["page_id"], field, i) not in found]
                assert r[field] == "\n".join(kept)
