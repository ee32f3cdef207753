from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session("4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars_of(spark):
    """bars_of({symbol: [(date, open, high, low, close, volume, amount), ...]})"""

    def make(rows: dict):
        from barline.sources.bars import BAR_SCHEMA

        flat = [(s, *r) for s, rs in rows.items() for r in rs]
        return spark.createDataFrame(flat, BAR_SCHEMA)

    return make


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def days(n: int, start: str = "2024-01-01") -> list[dt.date]:
    """n weekdays."""
    out, d = [], day(start)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def flat_bars(dates, price=100.0, volume=1000.0):
    return [(d, price, price, price, price, volume, price * volume) for d in dates]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
