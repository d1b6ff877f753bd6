"""The stateful landing stream: what waits, what is handed on once, and who has a destination in the end."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
import pytest

from sealroute.operators.codec import AesProvider
from sealroute.streaming.landing_stream import Settle, stream_landing
from tests.test_decrypt_job import put, request, seal, tree


class Map:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def iterator(self):
        return iter(self.held.items())


def polls(*listings):
    """What is handed on in each of several polls of one destination's files: (path, length, second of its time)."""
    state, settle, out = Map(), Settle(timedelta(hours=1)), []
    settle.init(SimpleNamespace(getMapState=lambda *args: state))
    for at, listing in enumerate(listings):
        rows = [SimpleNamespace(batch="b", root="r", path=path, name=path, length=length, modified=pd.Timestamp(time, unit="s"))
                for path, length, time in listing]
        timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda at=at: 1000 * at)
        out.append([(row.path, row.first_seen, row.before) for row in settle.handleInputRows(("c",), iter(rows), timer)])
    return out


def test_a_file_is_handed_on_once_when_two_polls_agree():
    assert polls([("a", 5, 1)], [("a", 5, 1)], [("a", 5, 1)], [("a", 5, 1)]) == [[], [("a", 0, [])], [], []]


def test_a_growing_or_changed_file_waits():
    assert polls([("a", 5, 1)], [("a", 6, 1)], [("a", 6, 2)], [("a", 6, 2)]) == [[], [], [], [("a", 0, [])]]
    assert polls([("a", None, 1)], [("a", None, 1)]) == [[], [("a", 0, [])]]


def test_a_new_version_is_handed_on_again():
    assert polls([("a", 5, 1)], [("a", 5, 1)], [], [("a", 7, 9)], [("a", 7, 9)])[-1] == [("a", 0, [])]


def test_files_know_of_higher_ones_handed_on_earlier():
    first, second = [("a", 1, 1), ("c", 1, 1)], [("a", 1, 1), ("c", 1, 1), ("b", 2, 1), ("d", 2, 1)]
    assert polls(first, second, [("b", 2, 1), ("d", 2, 1)]) == [
        [], [("a", 0, []), ("c", 0, [])], [("b", 1000, ["c"]), ("d", 1000, [])]]


@pytest.mark.parametrize("higher_decrypts", [True, False])
def test_destinations_across_micro_batches(spark, keys, tmp_path, higher_decrypts):
    sealed = seal(spark, keys, {"low": b"low", "high": b"high"})
    requests = request(spark, tmp_path, "a", "b", a={"destination_folder": "done"}, b={"destination_folder": "done"})
    run = lambda: stream_landing(requests, keys, AesProvider(), str(tmp_path / "work")).awaitTermination()
    put(tmp_path, {"inbound/b/x.csv.pgp": sealed["high"] if higher_decrypts else b"junk", "inbound/a/g.csv.pgp": b"half"})
    run()
    put(tmp_path, {"inbound/a/x.csv.pgp": sealed["low"], "inbound/a/g.csv.pgp": sealed["low"] + b""})
    run()
    run()
    left = tree(tmp_path)
    assert left["done/x.csv"] == (b"high" if higher_decrypts else b"low")
    assert left["done/g.csv"] == b"low"
    assert not [name for name in left if name.startswith(("inbound/", "done/."))]
    files = spark.read.parquet(str(tmp_path / "work/files")).collect()
    assert sorted((row.path, row.epoch, row.status, row.wins_dest) for row in files) == [
        ("inbound/a/g.csv.pgp", 2, "ok", True), ("inbound/a/x.csv.pgp", 2, "ok", not higher_decrypts),
        ("inbound/b/x.csv.pgp", 1, "ok" if higher_decrypts else "error", higher_decrypts)]


def test_state_is_asked_and_told_once_for_all_files_of_a_destination():
    calls, listing = [], [(f"{n}/x", 5, 1) for n in range(50)]

    class Counted(Map):
        def __getattribute__(self, name):
            if name != "held":
                calls.append(name)
            return super().__getattribute__(name)

    state, settle = Counted(), Settle(timedelta(hours=1))
    settle.init(SimpleNamespace(getMapState=lambda *args: state))
    handed = []
    for at in range(3):
        rows = [SimpleNamespace(batch="b", root="r", path=path, name="x", length=length, modified=pd.Timestamp(time, unit="s"))
                for path, length, time in listing]
        timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda at=at: 1000 * at)
        handed.append(len(list(settle.handleInputRows(("c",), iter(rows), timer))))
    assert handed == [0, 50, 0]
    # The third poll finds nothing new and writes nothing.
    assert calls == ["iterator", "updateValue", "iterator", "updateValue", "iterator"]


def test_a_file_s_state_expires_by_itself():
    state, settle = Map(), Settle(timedelta(seconds=10))
    settle.init(SimpleNamespace(getMapState=lambda *args: state))

    def poll(at, *paths):
        rows = [SimpleNamespace(batch="b", root="r", path=path, name="x", length=1, modified=pd.Timestamp(1, unit="s")) for path in paths]
        timer = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000 * at)
        return [(row.path, row.first_seen, row.before) for row in settle.handleInputRows(("c",), iter(rows), timer)]

    assert [poll(0, "b"), poll(1, "b"), poll(5, "a"), poll(6, "a")] == [[], [("b", 0, [])], [], [("a", 5000, ["b"])]]
    # The other file was last changed at 1 s; what is kept of the destination was written later.
    assert [poll(10, "b"), poll(11, "b"), poll(12, "b")] == [[], [], [("b", 11_000, [])]]
