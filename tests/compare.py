"""Rows of Spark and DuckDB, made comparable."""


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, plain.map(lambda v: v.item() if hasattr(v, "item") else v).itertuples(index=False, name=None)))


def same(spark_frame, sql_frame):
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert rows(spark_frame) == rows(sql_frame)
