import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillbook.functions.text import lines_of_text  # noqa: E402
from quillbook.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def to_lines(spark):
    def make(**texts):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(texts.items()), "file_name string, text string")
        return lines_of_text(df).select("file_name", F.lit(1).alias("page_no"), "line_no", "text")

    return make
