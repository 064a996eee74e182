"""Comparison of a Spark result with a DuckDB query on the same tables."""


def assert_same(df, con, sql):
    got, want = df.toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        differs = (got[c] != want[c]) & ~(got[c].isna() & want[c].isna())
        assert not differs.any(), (c, got[differs].head(3).to_dict("records"), want[differs].head(3).to_dict("records"))


def largest_join(df):
    """Most rows that a join of the executed plan made."""
    df.collect()

    def most(plan):
        name = plan.getClass().getSimpleName()
        inner = plan.executedPlan() if name.startswith("AdaptiveSparkPlan") else plan.plan() if name.endswith("QueryStageExec") else None
        children = plan.children()
        below = [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
        made = plan.metrics().get("numOutputRows")
        own = made.get().value() if "Join" in name and made.isDefined() else 0
        return max([own, *map(most, below)])

    return most(df._jdf.queryExecution().executedPlan())
