import logs
import pytest

from conftest import epoch
from tidemark.operators.login import login_fail_burst, login_fail_consecutive, login_fail_pattern
from tidemark.sources.text import read_events

ROWS = logs.login_rows()


@pytest.fixture(scope="module")
def login_log(spark, tmp_path_factory):
    path = logs.write_csv(tmp_path_factory.mktemp("logs") / "login.csv", ROWS)
    return read_events(spark, path, "login").cache()


def test_parsed_rows(login_log):
    got = sorted((r.user_id, r.ip, r.event_type, epoch(r.ts)) for r in login_log.collect())
    assert got == sorted(r[:4] for r in ROWS)


@pytest.mark.parametrize("within", [2, 8])
def test_pairs(login_log, within):
    want = logs.fail_pairs(ROWS, within)
    assert want
    for fn in (login_fail_pattern, login_fail_consecutive):
        got = sorted((r.user_id, epoch(r.first_fail_ts), epoch(r.last_fail_ts))
                     for r in fn(login_log, f"{within} seconds").collect())
        assert got == want


@pytest.mark.parametrize("window,n", [(2, 2), (10, 2), (60, 3)])
def test_bursts(login_log, window, n):
    got = sorted((r.user_id, epoch(r.first_fail_ts), epoch(r.last_fail_ts), r.warning)
                 for r in login_fail_burst(login_log, f"{window} seconds", n, bucket="7 seconds").collect())
    assert got == [(*x[:3], f"login fail in {window} seconds {x[3]} times")
                   for x in logs.fail_bursts(ROWS, window, n)]


def test_burst_counts_and_suppression(spark):
    from conftest import frame
    rows = [
        (1, "fail", 100, 1), (1, "fail", 101, 2), (1, "fail", 102, 3), (1, "fail", 103, 4),
        (2, "fail", 100, 5), (2, "fail", 101, 6), (2, "success", 102, 7),
        (3, "fail", 100, 8), (3, "success", 100, 9), (3, "fail", 100, 10), (3, "fail", 101, 11),
        (4, "fail", 100, 12), (4, "fail", 105, 13),
    ]
    df = frame(spark, rows, "user_id long, event_type string, ts long, seq long")
    got = sorted((r.user_id, epoch(r.first_fail_ts), epoch(r.last_fail_ts), r.warning)
                 for r in login_fail_burst(df, "2 seconds", 2, bucket="1 second").collect())
    assert got == [
        (1, 100, 102, "login fail in 2 seconds 3 times"),
        (3, 100, 101, "login fail in 2 seconds 2 times"),
    ]


def test_pattern_bound_is_strict(spark):
    from conftest import frame
    rows = [(1, "fail", 100, 1), (1, "fail", 102, 2), (2, "fail", 100, 3), (2, "fail", 101, 4)]
    df = frame(spark, rows, "user_id long, event_type string, ts long, seq long")
    assert [r.user_id for r in login_fail_pattern(df, "2 seconds").collect()] == [2]
