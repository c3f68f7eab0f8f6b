import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickweir.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


EVENT_DDL = ("event_id string, event_type string, timestamp timestamp_ntz, user_id string, session_id string, "
             "product_id string, product_name string, product_category string, product_price double, quantity int, "
             "total_amount decimal(18,2), payment_method string, city string, country string, ip_address string")

PRODUCTS = {"p1": ("Lamp", "Home", 10.0), "p2": ("Rope", "Sports", 5.0)}
PLACES = {"u1": ("Lyon", "France"), "u2": ("Oslo", "Norway"), "u3": (None, None)}


def event(event_id, time, kind, user, session, product=None, quantity=None, total=None, day="2025-01-03"):
    name, category, price = PRODUCTS.get(product, (None, None, None))
    city, country = PLACES.get(user, (None, None))
    return (event_id, kind, datetime.fromisoformat(f"{day} {time}"), user, session, product, name, category, price,
            quantity, None if total is None else Decimal(total), None, city, country, None)


GOLDEN = [
    event("e1", "10:30:01", "product_view", "u1", "s1", "p1"),
    event("e2", "10:30:05", "product_view", "u2", "s2", "p1"),
    event("e3", "10:30:10", "add_to_cart", "u1", "s1", "p1", 2),
    event("e4", "10:30:30", "purchase", "u1", "s1", "p1", 2, "20.00"),
    event("e5", "10:30:59.999", "search", "u3", "s3"),
    event("e6", "10:31:00", "product_view", "u2", "s2", "p2"),
    event("e7", "10:31:02", "add_to_cart", "u2", "s2", "p2", 1),
    event("e8", "10:31:03", "add_to_cart", "u2", "s2", "p1", 1),
    event("e9", "10:31:20", "remove_from_cart", "u2", "s2", "p2", 1),
    event("e10", "10:32:00", "purchase", "u2", "s2", "p1", 1, "10.00"),
]
AS_OF = "2025-01-03 10:33:00"


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, EVENT_DDL)


@pytest.fixture(scope="session")
def golden(frame):
    return frame(GOLDEN).cache()


def minute(clock: str) -> datetime:
    return datetime.fromisoformat(f"2025-01-03 {clock}")


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted((tuple(row) for row in df.select(*columns or df.columns).collect()), key=repr)
