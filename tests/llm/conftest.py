import pytest


@pytest.fixture
def make(spark):
    """Documents with two more columns whose names operators use themselves, and that must come through."""

    def made(rows, extra=False, schema="doc_id bigint, text string"):
        if extra:
            names = ", ".join(f"`{c}` string" for c in ("node", "seqs", "form", "score", "hash", "item_id", "n"))
            return spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in "abcdefg"]) for r in rows], f"{schema}, {names}")
        return spark.createDataFrame(rows, schema)

    return made


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
