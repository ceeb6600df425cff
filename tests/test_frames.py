"""Frames of trials as a stream: due by events, due by time, gone after the end, and kept over a restart."""

from __future__ import annotations

import json
import time

import pytest

from trialweave.streaming import frames


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of event files, a stream of it, and the frames seen so far."""
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen, n = [], [0]

    def put(*rows):
        n[0] += 1
        lines = [json.dumps({"trial_id": t, "seq": s, "kind": k, "snapshot": f"{t}{s}"}) for t, s, k in rows]
        part = tmp_path / f"{n[0]}.part"
        part.write_text("\n".join(lines))
        part.rename(tmp_path / "in" / f"{n[0]}.json")

    def start(**options):
        events = spark.readStream.schema("trial_id string, seq long, kind string, snapshot string").json(f"file://{tmp_path}/in")
        return frames.watch_frames(events, lambda df, i: seen.extend(df.collect()), f"file://{tmp_path}/state", every="200 milliseconds", **options)

    def wait(ok, seconds=90):
        end = time.time() + seconds
        while not ok() and time.time() < end:
            time.sleep(0.1)
        assert ok(), [(r["trial_id"], r["frame"], r["cause"], r["elapsed_ms"], r["last_seq"]) for r in seen]

    yield put, start, wait, seen
    for q in spark.streams.active:
        q.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_frames_by_event_and_by_time(feed):
    put, start, wait, seen = feed
    put(("a", 0, "trial-start"), ("a", 2, "stage-start"), ("a", 1, "request-sent"), ("b", 0, "trial-start"), (None, 1, "attempt"))
    q = start(redraw_ms=1500, ended_ms=600_000)
    wait(lambda: {(r["trial_id"], r["cause"]) for r in seen} >= {("a", "first"), ("b", "first")})
    first = next(r for r in seen if r["trial_id"] == "a")
    assert (first["last_seq"], first["last_kind"], first["last_snapshot"], first["events"], first["working"], first["ended"], first["frame"]) == (2, "stage-start", "a2", 3, True, False, 1)
    # No event comes, and yet a frame is due.
    wait(lambda: any(r["cause"] == "timer" and r["trial_id"] == "a" for r in seen))
    timed = next(r for r in seen if r["cause"] == "timer" and r["trial_id"] == "a")
    assert timed["elapsed_ms"] >= 1500 and timed["last_seq"] == 2 and timed["frame"] == 2
    # A restart goes on with the trials and their timers, as soon as any event comes.
    q.stop()
    at = len(seen)
    q = start(redraw_ms=1500, ended_ms=600_000)
    put(("c", 0, "trial-start"))
    wait(lambda: any(r["cause"] == "timer" and r["trial_id"] == "b" for r in seen[at:]))
    assert all(r["frame"] > 1 for r in seen[at:] if r["trial_id"] != "c")
    put(("a", 3, "attempt"), ("a", 4, "trial-end"))
    wait(lambda: any(r["ended"] for r in seen))
    end = next(r for r in seen if r["ended"])
    assert (end["trial_id"], end["cause"], end["last_kind"], end["events"], end["working"]) == ("a", "end", "trial-end", 5, False)
    # After the end nothing is drawn, neither by time nor for late events.
    at = len(seen)
    put(("a", 2, "request-sent"))
    wait(lambda: sum(r["trial_id"] == "b" for r in seen[at:]) >= 2)
    assert not any(r["trial_id"] == "a" for r in seen[at:])
    # A new start draws again.
    put(("a", 10, "trial-start"))
    wait(lambda: any(r["trial_id"] == "a" and r["cause"] == "first" for r in seen[at:]))
    q.stop()


def test_the_mark_of_an_end_expires(feed):
    put, start, wait, seen = feed
    put(("a", 0, "trial-start"), ("a", 5, "trial-end"))
    q = start(redraw_ms=60_000, ended_ms=1000, terminal=False)
    wait(lambda: len(seen) == 1)
    assert seen[0]["ended"] and seen[0]["cause"] == "end" and seen[0]["frame"] == 1
    time.sleep(3)
    put(("a", 4, "attempt"))  # of a trial that is forgotten, so this is news, which only a terminal shows
    put(("a", 6, "trial-end"))
    wait(lambda: len(seen) == 2)
    assert seen[1]["last_seq"] == 6 and seen[1]["events"] in (1, 2)
    q.stop()
