import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators use inside."""

    def make(rows, **more):
        data = [(i, x, *(v(i) if callable(v) else v for v in more.values())) for i, x in rows]
        names = ["doc_id long", "text string", *(f"{k} {'string' if k == 'source' else 'long'}" for k in more)]
        return spark.createDataFrame(data, ", ".join(names)).repartition(3)

    return make


#: Nulls, empty and blank texts, repeats and non-ASCII.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "Ünïcode ÄÖ ß \U0001f600 end"), (6, "ONE"), (None, "no id here at all"), (None, None), (7, "a\n\nb\n")]
