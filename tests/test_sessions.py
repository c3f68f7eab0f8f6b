import random
from datetime import datetime, timedelta

from clickweir.operators import sessions
from conftest import event, rows


def test_sessions_equal_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2025, 1, 3)
    data = [(rng.choice(["a", "a", "a", "b", "c"]), start + timedelta(seconds=rng.randint(0, 40_000))) for _ in range(900)]
    data += [("d", start + timedelta(minutes=5 * i)) for i in range(4)]           # exactly one gap apart
    data += [("e", start + timedelta(minutes=5 * i, microseconds=-i)) for i in range(4)]
    want = []
    for user in "abcde":
        times = sorted(t for u, t in data if u == user)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] >= timedelta(minutes=5):
                want.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((user, run[0], run[-1], len(run)))
    df = spark.createDataFrame(data, "user_id string, timestamp timestamp_ntz")
    assert rows(sessions.sessionize(df)) == sorted(want, key=repr)
    assert sum(1 for w in want if w[0] == "d") == 4 and sum(1 for w in want if w[0] == "e") == 1


def test_a_busy_user_becomes_few_cells(spark):
    df = spark.range(300_000).selectExpr(
        "'hot' AS user_id", "timestamp_ntz'2025-01-03' + make_dt_interval(0, 0, 0, id / 100) AS timestamp")
    assert rows(sessions.sessionize(df), "event_count") == [(300_000,)]


def test_carts(golden):
    assert sessions.cart_state(golden).count() == 0
    assert rows(sessions.cart_state(golden, as_of="2025-01-03 10:32:00")) == [("s2", "p1", 1)]


def test_session_funnel(golden, frame):
    assert rows(sessions.session_funnel(golden)) == [(3, 2, 2, 2)]
    backwards = frame([event("a", "10:00:00", "purchase", "u1", "s1", "p1", 1, "1.00"),
                       event("b", "10:00:01", "add_to_cart", "u1", "s1", "p1", 1),
                       event("c", "10:00:02", "product_view", "u1", "s1", "p1")])
    assert rows(sessions.session_funnel(backwards)) == [(1, 1, 0, 0)]
    early = frame([event("a", "00:00:00", "add_to_cart", "u1", "s1", "p1", 1), event("b", "00:01:00", "product_view", "u1", "s1", "p1"),
                   event("c", "00:02:00", "add_to_cart", "u1", "s1", "p1", 1), event("d", "00:03:00", "purchase", "u1", "s1", "p1", 1, "1.00"),
                   event("e", "00:03:00", "product_view", "u1", None, "p1"), event("f", "00:03:00", "purchase", "u1", "s2", "p1", 1, "1.00")])
    assert rows(sessions.session_funnel(early)) == [(2, 1, 1, 1)]


def test_no_session_without_a_user(frame):
    df = frame([event("a", "00:00:00", "search", None, "s1"), event("b", "00:00:01", "search", "u1", "s1")])
    assert rows(sessions.sessionize(df), "user_id", "event_count") == [("u1", 1)]
