"""The library's questions to a small source tree, answer by answer."""

from __future__ import annotations

import duckdb
import pytest
from corpus_queries import ANSWERS, QUESTIONS
from oracle import differences


@pytest.mark.parametrize("name", list(QUESTIONS))
def test_answer(spark, name):
    assert differences(QUESTIONS[name](spark, "").toPandas(), duckdb.connect().execute(ANSWERS[name]).df()) == ""


def test_samples_have_rows(spark):
    from quarry.functions import images, python_source
    from quarry.operators import markup

    source = python_source.samples(spark)
    assert all(df.count() for df in (python_source.nodes(source), python_source.calls(source), python_source.skeletons(source), markup.template_nodes(markup.samples(spark)), images.meta(images.samples(spark))))
