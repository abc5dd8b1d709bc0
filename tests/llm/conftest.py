import pytest


@pytest.fixture
def documents(spark):
    """Make a documents table from (doc_id, text, lang, source) rows, or fewer fields."""

    def make(rows, partitions=3):
        full = [(*r, *([None] * (4 - len(r)))) for r in rows]
        full = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)

    return make
