import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packetsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def packet_rows(spark):
    """Random packets with ids, ties, gaps and bad values, as (row_id, columns)."""
    import numpy as np
    import pandas as pd

    from packetsieve.schema import CATEGORICAL, ROW_ID, STORED_NUMERIC, TIMESTAMP

    def build(n: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        start = pd.Timestamp("2024-03-09 23:59:50")
        times = start + pd.to_timedelta(rng.integers(0, max(1, n * 3), n) * 250, unit="ms")
        frame = pd.DataFrame({ROW_ID: np.arange(n), TIMESTAMP: times.astype(str)})
        frame.loc[rng.random(n) < 0.05, TIMESTAMP] = "bad"
        for i, c in enumerate(CATEGORICAL):
            values = [f"{c}{v}" for v in range(3 + 5 * i)] + [None]
            frame[c] = rng.choice(np.array(values, dtype=object), n)
        for c in STORED_NUMERIC:
            frame[c] = rng.integers(0, 1000, n).astype(str)
        frame.loc[rng.random(n) < 0.1, "http_response_code"] = "5xx"
        return spark.createDataFrame(frame)

    return build
