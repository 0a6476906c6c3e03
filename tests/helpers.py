"""Small helpers shared by the tests."""


def rows(df):
    return [tuple(row) for row in df.collect()]


def row_set(df):
    return sorted(rows(df), key=repr)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
