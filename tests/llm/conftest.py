from datetime import datetime

import pytest

NODES = "id long, type string, code string, test_id string, filepath string, line int, loaded_at timestamp"


@pytest.fixture
def nodes(spark):
    """Make a table of nodes from (id, code) or (id, code, test_id) rows, with a column whose name an operator might use itself."""

    def make(rows):
        full = [(r[0], "Statement", r[1], r[2] if len(r) > 2 else None, None, None, datetime(2040, 1, 1), "x", "y") for r in rows]
        return spark.createDataFrame(full, NODES + ", h string, sid string")

    return make
