import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(id, text), ...]) with the columns of the table, and more on request."""
    def make(rows, extra=()):
        schema = DOCS + "".join(f", `{name}` string" for name in extra)
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), *["x"] * len(extra)) for i, t in rows], schema)
    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="session")
def collected():
    return rows
