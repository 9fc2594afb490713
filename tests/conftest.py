import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from datasonde_queries.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g")


@pytest.fixture(scope="session")
def make(spark):
    """A DataFrame from columns, with a DDL schema."""

    def build(schema: str, **columns):
        rows = list(zip(*columns.values()))
        return spark.createDataFrame(rows, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def frame():
    """The rows of a DataFrame as pandas, sorted by the given columns."""

    def collect(df, *by):
        rows = [r.asDict() for r in df.collect()]
        out = pd.DataFrame(rows, columns=df.columns)
        return out.sort_values(list(by)).reset_index(drop=True) if by else out

    return collect
