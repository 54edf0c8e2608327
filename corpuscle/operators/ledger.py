"""Work-item ledger: pending, leased and done units with fencing tokens, on any Hadoop file system.

The ledger is a sequence of immutable state files ``<root>/ledger/<version>.json``. A transition reads the newest
version and publishes the next one by a rename that fails if that version exists already, so two writers can not both
win (optimistic concurrency). HDFS and local file systems rename that way; on an object store without it the folder
must lie on a committer or connector that offers a conditional put, or state files on another file system. A state file
has one entry per *unit*. A unit is a range of the hash of work items, so the number of entries is chosen when the run
is planned and does not grow with retries.

* ``lease`` hands out pending units, and leased ones whose lease has expired, under a new, larger fencing token;
  ``renew`` prolongs a lease that is still held, which ``run_ledger`` does while its job runs.
* ``complete`` accepts a unit only from the token that holds it now; a writer whose lease was taken over is refused.
* Results go to ``<root>/out/token=<t>/unit=<u>``: a retried task of one lease writes the same path again, another
  lease writes another path, and readers take only paths named by a *done* entry. Half-written output is never seen.
  How many files a unit has is kept with its entry; if one is missing later, reading raises ``LostOutput`` and
  ``reopen`` makes the unit pending again.

``Runs`` strings runs together: it keeps which run is open or done last, its plan, and what the run leaves for the next
one. What a run leaves counts only once the run is done, so a run that failed is taken up, never skipped or repeated.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleLease(RuntimeError):
    """A completion under a token that no longer holds the unit."""


class LostOutput(RuntimeError):
    """Output of a done unit is no longer there."""


class _Conflict(RuntimeError):
    pass


class _Fs:
    """The few file operations the ledger needs, through Hadoop's FileContext."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.jvm, self.gateway = sc._jvm, sc._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.conf = sc._jsc.hadoopConfiguration()
        root_path = self.path(root)
        self.fs = root_path.getFileSystem(self.conf)
        self.fc = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write a file that becomes visible whole, or raise if its name is taken."""
        tmp = self.path(f"{path}.{time.time_ns()}.tmp")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.fc.rename(tmp, self.path(path), none)
        except Exception as e:
            self.fs.delete(tmp, False)
            if self.exists(path):
                raise _Conflict(path) from e
            raise


def path_exists(spark: SparkSession, path: str) -> bool:
    return _Fs(spark, path).exists(path)


def _newest(fs: _Fs, folder: str, default: dict) -> tuple[int, dict]:
    """Number and content of the newest state file."""
    names = [n for n in fs.names(folder) if n.endswith(".json")]
    return (int(names[-1][:-5]), json.loads(fs.read(f"{folder}/{names[-1]}"))) if names else (-1, default)


@dataclass(frozen=True)
class Lease:
    token: int
    units: tuple[int, ...]


class Ledger:
    """See the module. ``clock`` is injectable so that tests can let leases expire."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.fs = _Fs(spark, root)

    # -- state files
    def _load(self) -> tuple[int, dict]:
        return _newest(self.fs, f"{self.root}/ledger", {"token": 0, "units": {}})

    def _change(self, f: Callable[[dict], object]):
        while True:
            version, state = self._load()
            out = f(state)
            try:
                self.fs.publish(f"{self.root}/ledger/{version + 1:012d}.json", json.dumps(state))
                return out
            except _Conflict:
                continue

    # -- transitions
    def seed(self, units: int) -> None:
        """Add units 0..n-1 as pending; those already known keep their state."""

        def f(state):
            for u in range(units):
                state["units"].setdefault(str(u), {"state": "pending", "token": 0, "until": 0.0})

        self._change(f)

    def lease(self, seconds: float, most: int | None = None) -> Lease | None:
        """Take up to ``most`` units that are pending or whose lease ran out; None if there is none."""
        now = self.clock()

        def f(state):
            free = [int(u) for u, e in state["units"].items() if e["state"] == "pending" or e["state"] == "leased" and e["until"] <= now]
            free = sorted(free)[:most]
            if not free:
                return None
            state["token"] += 1
            for u in free:
                state["units"][str(u)] = {"state": "leased", "token": state["token"], "until": now + seconds}
            return Lease(state["token"], tuple(free))

        return self._change(f)

    def _held(self, state: dict, lease: Lease) -> None:
        for u in lease.units:
            e = state["units"][str(u)]
            if e["state"] != "leased" or e["token"] != lease.token:
                raise StaleLease(f"unit {u}: {e['state']} under token {e['token']}, not {lease.token}")

    def renew(self, lease: Lease, seconds: float) -> None:
        """Prolong a lease; StaleLease if a unit was taken over."""
        until = self.clock() + seconds

        def f(state):
            self._held(state, lease)
            for u in lease.units:
                state["units"][str(u)]["until"] = until

        self._change(f)

    def complete(self, lease: Lease) -> None:
        """Mark all units of the lease done; StaleLease if any was taken over, and then none is marked."""
        files = self._files(lease.token)

        def f(state):
            self._held(state, lease)
            for u in lease.units:
                state["units"][str(u)].update(state="done", files=files.get(u, 0))

        self._change(f)

    def _files(self, token: int) -> dict[int, int]:
        """How many files each unit of a token has."""
        folder = self.out_path(token)
        units = [n for n in self.fs.names(folder) if n.startswith("unit=")]
        return {int(n[5:]): sum(not x.startswith(("_", ".")) for x in self.fs.names(f"{folder}/{n}")) for n in units}

    def reopen(self, units: list[int]) -> None:
        """Make units pending again, as after lost output."""

        def f(state):
            for u in units:
                state["units"][str(u)] = {"state": "pending", "token": 0, "until": 0.0}

        self._change(f)

    def lost(self) -> list[int]:
        """Done units of which output is missing."""
        by_token: dict[int, dict[int, int]] = {}
        for u, e in self._load()[1]["units"].items():
            if e["state"] == "done" and e.get("files"):
                by_token.setdefault(e["token"], {})[int(u)] = e["files"]
        out = []
        for token, units in by_token.items():
            there = self._files(token)
            out += [u for u, n in units.items() if there.get(u, 0) < n]
        return sorted(out)

    def release(self, lease: Lease) -> None:
        """Give units back at once, as after a caught failure."""

        def f(state):
            for u in lease.units:
                e = state["units"][str(u)]
                if e["state"] == "leased" and e["token"] == lease.token:
                    e["state"], e["until"] = "pending", 0.0

        self._change(f)

    def states(self) -> dict[int, tuple[str, int]]:
        return {int(u): (e["state"], e["token"]) for u, e in self._load()[1]["units"].items()}

    def finished(self) -> bool:
        s = self.states()
        return bool(s) and all(x == "done" for x, _ in s.values())

    def out_path(self, token: int) -> str:
        return f"{self.root}/out/token={token}"

    def results(self, schema) -> DataFrame:
        """Rows of the done units only. ``schema`` is that of the results without the unit column."""
        if missing := self.lost():
            raise LostOutput(f"units {missing[:20]} of {self.root}")
        by_token: dict[int, list[int]] = {}
        for u, e in self._load()[1]["units"].items():
            if e["state"] == "done" and e.get("files"):
                by_token.setdefault(e["token"], []).append(int(u))
        out = None
        for token, units in sorted(by_token.items()):
            df = self.spark.read.option("basePath", self.out_path(token)).schema(f"{_ddl(schema)}, unit int").parquet(self.out_path(token))
            df = df.where(F.col("unit").isin(units)).drop("unit")
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], schema)


class Runs:
    """The sequence of runs below ``root``: at most one is open, and what the last done one left is known."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.fs = _Fs(spark, root)

    def head(self) -> tuple[int, dict]:
        return _newest(self.fs, f"{self.root}/runs", {"run": 0, "state": "done", "left": None})

    def begin(self, plan: Callable[[str, dict | None], dict]) -> dict:
        """The open run, or a new one. ``plan(folder, left)`` writes its plan below ``folder`` and says what the run leaves.

        Two callers may plan at the same time, each in a folder of its own; one becomes the run, the other is dropped.
        """
        version, head = self.head()
        if head["state"] == "open":
            return head
        folder = f"{self.root}/run-{head['run'] + 1:06d}-{uuid.uuid4().hex}"
        made = {"run": head["run"] + 1, "state": "open", "folder": folder, "before": head["left"], "left": plan(folder, head["left"])}
        try:
            self.fs.publish(f"{self.root}/runs/{version + 1:012d}.json", json.dumps(made))
            return made
        except _Conflict:
            self.fs.delete(folder)
            return self.head()[1]

    def finish(self, run: dict) -> None:
        """Only now does what the run leaves hold. Another runner of the same run may have finished it."""
        version, head = self.head()
        if head["run"] == run["run"] and head["state"] == "open":
            try:
                self.fs.publish(f"{self.root}/runs/{version + 1:012d}.json", json.dumps({**head, "state": "done"}))
            except _Conflict:
                pass


def _ddl(schema) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


#: Slots of the hash by which items are divided into units.
SLOTS = 1 << 31


def with_slot(items: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with a slot that is a function of the key alone, sorted by it, so that a range of slots is read alone."""
    return items.withColumn("slot", F.shiftrightunsigned(F.xxhash64(*keys), 33).cast("int")).sortWithinPartitions("slot")


def of_units(planned: DataFrame, units: tuple[int, ...], n: int) -> DataFrame:
    """The items of some of ``n`` units, with their unit; neighbouring units make one range of slots."""
    ranges: list[list[int]] = []
    for u in sorted(units):
        if ranges and ranges[-1][1] == u:
            ranges[-1][1] = u + 1
        else:
            ranges.append([u, u + 1])
    lo = [(-(-a * SLOTS // n), -(-b * SLOTS // n) - 1) for a, b in ranges]
    keep = F.lit(False)
    for a, b in lo:
        keep = keep | F.col("slot").between(a, b)
    return planned.where(keep).withColumn("unit", F.shiftright(F.col("slot").cast("bigint") * n, 31).cast("int"))


class _Renewing:
    """Renews a lease from a thread of its own while a job runs."""

    def __init__(self, ledger: Ledger, lease: Lease, seconds: float):
        self.ledger, self.lease, self.seconds = ledger, lease, seconds
        self.over = threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.over.wait(self.seconds / 3):
            try:
                self.ledger.renew(self.lease, self.seconds)
            except StaleLease:  # complete() will say so
                return

    def __enter__(self):
        self.thread.start()

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def run_ledger(
    items: DataFrame | None,
    keys: list[str],
    process: Callable[[DataFrame], DataFrame],
    root: str,
    spark: SparkSession,
    rows_per_unit: int = 1_000_000,
    lease_s: float = 3600.0,
    wave: int = 64,
    clock: Callable[[], float] = time.time,
    fail_after: Callable[[Lease], None] | None = None,
    planned: DataFrame | None = None,
    count: int | None = None,
) -> DataFrame:
    """Plan ``items`` into units once, then lease, process and complete them, ``wave`` at a time, until all are done.

    Called again on the same ``root`` after a crash it goes on with the stored plan: done units are not processed
    again, and those under a dead lease follow when that expires. ``items`` may be None then. ``process`` must map
    rows one by one or within a unit. A caller that has written its plan already passes it as ``planned`` (with slots)
    and its ``count``. ``fail_after`` is a test hook, called between output and completion.
    """
    ledger = Ledger(spark, root, clock)
    plan = f"{ledger.root}/plan"
    if planned is None:
        if not ledger.fs.exists(f"{plan}/_SUCCESS"):
            if items is None:
                raise ValueError("nothing is planned here")
            # the slots are a function of the key alone, so a plan that is written again is the same
            with_slot(items, keys).write.mode("overwrite").parquet(plan)
        planned = spark.read.parquet(plan)
    if not ledger.states():
        ledger.seed(max(1, -(-(planned.count() if count is None else count) // rows_per_unit)))
    n = len(ledger.states())
    schema = None
    while (lease := ledger.lease(lease_s, wave)) is not None:
        out = process(of_units(planned, lease.units, n))
        schema = out.drop("unit").schema
        with _Renewing(ledger, lease, lease_s):
            out.write.mode("overwrite").partitionBy("unit").parquet(ledger.out_path(lease.token))
        if fail_after:
            fail_after(lease)
        ledger.complete(lease)
    if not ledger.finished():
        raise RuntimeError("units are still leased to another run")
    return ledger.results(schema or process(planned.withColumn("unit", F.lit(0))).drop("unit").schema)
