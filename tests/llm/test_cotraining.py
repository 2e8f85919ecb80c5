"""Every unlabelled document takes part in co-training, however many there are."""

import numpy as np
import pytest

from factloom.llm.cotraining import train


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(4400):
        good = i % 2
        text = " ".join(("good%d" if good else "bad%d") % x for x in rng.integers(0, 30, 12))
        rows.append((i, text, "en", "clean" if good else "junk"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")


def test_all_unlabelled_documents_are_given(tables):
    model = train(*tables)
    assert all(n == 4000 for n in model.given[0]) and len(model.given) == 5


def test_sums_do_not_depend_on_partitions(tables):
    docs, labels = tables
    a, b = train(docs.repartition(1), labels), train(docs.repartition(7), labels)
    assert a.given == b.given and (a.text.weights == b.text.weights).all() and (a.page.weights == b.page.weights).all()
