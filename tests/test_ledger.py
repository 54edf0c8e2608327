import datetime as dt

import pytest

from corpuscle.operators import incremental
from corpuscle.operators.ledger import Ledger, LostOutput, Runs, StaleLease, run_ledger
from corpuscle.session import shared_dir

LISTING = "ws string, rel string, size bigint, mtime double, hash string, gone boolean, facade string, seen_at timestamp, arrived_at timestamp"
FILE = "ws string, rel string, size bigint, mtime double, hash string"


def t(n):
    return dt.datetime(2031, 1, 1) + dt.timedelta(minutes=n)


def changed(spark, listings, files):
    rows = [(w, r, s, m, h, g, "f", t(a), t(b)) for w, r, s, m, h, g, a, b in listings]
    out = incremental.changed_files(spark.createDataFrame(rows, LISTING), spark.createDataFrame(files, FILE))
    return sorted((r["ws"], r["rel"]) for r in out.collect())


def test_what_counts_as_changed(spark):
    listings = [
        ("w", "new", 1, 1.0, "0a", False, 1, 1), ("w", "new", 1, 1.0, "0a", False, 1, 9),  # delivered twice
        ("w", "same", 1, 2.0, "00AB", False, 1, 1),  # another time, equal number
        ("w", "other", 1, 1.0, "ff", False, 1, 1),
        ("w", "late", 1, 1.0, "ff", False, 5, 1), ("w", "late", 1, 1.0, "ab", False, 2, 9),  # the older one arrived later
        ("w", "gone", None, None, None, True, 3, 3), ("w", "gone", 1, 1.0, "ff", False, 1, 1),
        ("w", "moved", 2, 1.0, None, False, 1, 1), ("w", "still", 1, 1.0, None, False, 1, 1), ("w", "blank", 1, 1.0, " ", False, 1, 1),
        ("w", "nulls", None, None, None, False, 1, 1), ("w", "nogone", 1, 1.0, "1", None, 1, 1),
        (None, "x", 1, 1.0, "1", False, 1, 1), ("w", None, 1, 1.0, "1", False, 1, 1),
    ]
    files = [("w", r, 1, 1.0, "AB") for r in ("same", "other", "late", "gone", "moved", "still", "blank")] + [("w", "nulls", 5, 1.0, None)]
    files += [("w", "same", 1, 1.0, "AB")]  # an exact copy
    assert changed(spark, listings, files) == [("w", r) for r in ("late", "moved", "new", "nogone", "nulls", "other")]


def test_empty_tables(spark):
    assert changed(spark, [], [("w", "a", 1, 1.0, "1")]) == []
    assert changed(spark, [("w", "a", 1, 1.0, "1", False, 1, 1)], []) == [("w", "a")]


def test_leases_expire_and_tokens_fence(spark):
    now = [100.0]
    led = Ledger(spark, shared_dir(spark, "t"), clock=lambda: now[0])
    led.seed(3)
    a = led.lease(10, most=2)
    b = led.lease(10)
    assert a.units == (0, 1) and b.units == (2,) and led.lease(10) is None
    led.complete(b)
    now[0] = 111
    c = led.lease(10)
    assert c.units == (0, 1) and c.token > a.token
    with pytest.raises(StaleLease):
        led.complete(a)  # its writer was thought dead
    led.complete(c)
    with pytest.raises(StaleLease):
        led.complete(c)
    assert led.finished()
    led.seed(4)  # one more; the done ones stay done
    assert [s for s, _ in led.states().values()] == ["done", "done", "done", "pending"]


def test_two_writers_can_not_both_win(spark):
    root = shared_dir(spark, "t")
    one, two = Ledger(spark, root), Ledger(spark, root)
    one.seed(4)
    x, y = one.lease(10, 2), two.lease(10, 2)
    assert set(x.units) | set(y.units) == {0, 1, 2, 3} and not set(x.units) & set(y.units)


def test_a_run_that_died_is_taken_up(spark):
    root, seen = shared_dir(spark, "t"), []
    items = spark.range(1000).withColumnRenamed("id", "k")
    now = [0.0]

    def process(df):
        return df.select("unit", "k")

    def die(lease):
        seen.append(lease.units)
        if len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        run_ledger(items, ["k"], process, root, spark, rows_per_unit=250, wave=1, lease_s=60, clock=lambda: now[0], fail_after=die)
    now[0] = 61  # the dead one's lease is over; its output was written but never completed
    out = run_ledger(None, ["k"], process, root, spark, rows_per_unit=250, wave=1, lease_s=60, clock=lambda: now[0], fail_after=lambda l: seen.append(l.units))
    assert sorted(r["k"] for r in out.collect()) == list(range(1000))
    assert seen.count((0,)) == 1 and seen.count((1,)) == 2  # only the unit that was not completed came again
    assert run_ledger(None, ["k"], process, root, spark).count() == 1000  # nothing is left to do


def test_a_lease_is_renewed_while_it_is_held(spark):
    now = [0.0]
    led = Ledger(spark, shared_dir(spark, "t"), clock=lambda: now[0])
    led.seed(1)
    a = led.lease(10)
    now[0] = 8
    led.renew(a, 10)
    now[0] = 15
    assert led.lease(10) is None
    now[0] = 19
    led.lease(10)
    with pytest.raises(StaleLease):
        led.renew(a, 10)


def test_lost_output_is_an_error_and_can_be_made_again(spark):
    import shutil

    root = shared_dir(spark, "t")
    items = spark.range(100).withColumnRenamed("id", "k")
    process = lambda df: df.select("unit", "k").where("k <> 7")
    assert run_ledger(items, ["k"], process, root, spark, rows_per_unit=25).count() == 99
    led = Ledger(spark, root)
    token = led.states()[2][1]
    shutil.rmtree(f"{root.removeprefix('file:')}/out/token={token}/unit=2")
    with pytest.raises(LostOutput):
        run_ledger(None, ["k"], process, root, spark)
    led.reopen(led.lost())
    assert run_ledger(None, ["k"], process, root, spark).count() == 99
    assert run_ledger(items.limit(0), ["k"], process, shared_dir(spark, "t"), spark).count() == 0


def feed(spark, rows):
    return spark.createDataFrame([("w", r, 1, 1.0, h, g, "f", t(a), t(b)) for r, h, g, a, b in rows], LISTING)


def test_runs_follow_each_other_on_one_root(spark):
    root, files = shared_dir(spark, "t"), spark.createDataFrame([("w", "old", 1, 1.0, "AB"), ("w", "same", 1, 1.0, "AB")], FILE)
    got = lambda rows, **o: sorted(r["rel"] for r in incremental.process_changes(spark, feed(spark, rows), files, root, **o).collect())
    one = [("old", "CD", False, 10, 10), ("same", "AB", False, 10, 10), ("new", "01", False, 10, 11)]
    assert incremental.last_success(spark, root) is None
    assert got(one) == ["new", "old"]
    assert incremental.last_success(spark, root) == "2031-01-01 00:11:00"
    assert got(one) == []  # nothing came since
    two = [("old", "EF", False, 20, 20), ("same", "FF", False, 5, 20), ("late", "02", False, 3, 12), ("new", "01", False, 21, 21), ("same", "AB", True, 22, 22)]
    # changed again; an older state that comes late; a new file that comes late; the same once more; gone

    def die(lease):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        got(one + two, fail_after=die, lease_s=0.0)
    assert incremental.last_success(spark, root) == "2031-01-01 00:11:00"
    three = [("same", "AB", False, 30, 30), ("next", "03", False, 30, 30)]
    assert got(one + two + three) == ["late", "old"]  # the run that failed is taken up; what came meanwhile waits
    assert incremental.last_success(spark, root) == "2031-01-01 00:22:00"
    assert got(one + two + three) == ["next", "same"]  # back again after it was gone
    assert got(one + two + three + [("late", "02", False, 31, 31)]) == []
    assert Runs(spark, root).head()[1]["run"] == 5


def test_runs_over_nothing(spark):
    files, root = spark.createDataFrame([("w", "a", 1, 1.0, "AB")], FILE), shared_dir(spark, "t")
    for listings in (feed(spark, []), feed(spark, [("a", "AB", False, 1, 1)]).limit(0), feed(spark, [("a", "AB", False, 1, 1)])):
        assert incremental.process_changes(spark, listings, files, root).count() == 0
    assert incremental.process_changes(spark, feed(spark, [("a", "AB", False, 1, 1)]), files.limit(0), shared_dir(spark, "t")).count() == 1


def test_two_planners_make_one_run(spark):
    runs = Runs(spark, shared_dir(spark, "t"))
    inner = []

    def plan(folder, left):
        if not inner:
            inner.append(Runs(spark, runs.root).begin(lambda f, l: {"by": "other"}))
        return {"by": "me"}

    assert runs.begin(plan)["left"] == {"by": "other"} == inner[0]["left"]
