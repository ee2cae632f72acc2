"""Keyed state of the streaming jobs: named variables and event-time timers of a host's gate and of a URL's retries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from gleanery.config import Config
from gleanery.operators import hosts

GATE_OUT = "host string, gate string, state string, strikes int, requests long, at double"
RETRY_OUT = "url_hash string, attempts int, at double, next_at double, outcome string"


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_columns(schema))


class Timers:
    """The timers of the key at hand; none is set in the past of the watermark, where it would never be due again."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def set(self, at: float, now: TimerValues) -> None:
        self.handle.registerTimer(max(int(at * 1000), now.getCurrentWatermarkInMs() + 1))

    def clear(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)


class HostGate(StatefulProcessor):
    """The gate of a host. State: ``gate`` (what holds, since when, until when), ``strikes``, ``limited`` (the last rate limit, for a day) and ``robots`` (the file seen last).

    Each wait has a timer at its end and each rate limit one at which it is forgotten; a stop clears them all.
    """

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = Timers(handle)
        self.gate = handle.getValueState("gate", "gate string, state string, since double, until double, requests long")
        self.strikes = handle.getValueState("strikes", "n int")
        self.limited = handle.getValueState("limited", "at double")
        self.robots = handle.getValueState("robots", "hash string")

    def _load(self) -> dict:
        one = lambda state: state.get()[0] if state.exists() else None
        gate, kind, since, until, requests = self.gate.get() if self.gate.exists() else (None, None, None, None, 0)
        return {"gate": gate, "state": kind, "since": since, "until": until, "requests": requests, "strikes": one(self.strikes) or 0, "limited": one(self.limited), "robots": one(self.robots)}

    def _save(self, s: dict) -> None:
        self.gate.update((s["gate"], s["state"], s["since"], s["until"], s["requests"]))
        for state, name in ((self.strikes, "strikes"), (self.limited, "limited"), (self.robots, "robots")):
            if s[name]:
                state.update((s[name],))

    def _until(self, s: dict) -> float | None:
        if s["state"] not in hosts.PASSING:
            return None
        return s["since"] + (self.config.strike_hours * 3600 if s["state"] == "cool_off" else self.config.retry_after_seconds)

    def _keep(self, s: dict, now: TimerValues) -> None:
        """Saves the state with its timers."""
        s["until"] = self._until(s)
        self.timers.clear()
        if s["until"] is not None:
            self.timers.set(s["until"], now)
        if s["limited"] is not None and s["state"] not in ("permanent", "stopped"):
            self.timers.set(s["limited"] + self.config.strike_hours * 3600, now)
        self._save(s)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        row = initialState.iloc[0]
        value = lambda c: None if pd.isna(row[c]) else row[c]
        seconds = lambda c: None if value(c) is None else float(value(c))
        s = {"gate": value("gate"), "state": value("state"), "since": seconds("since"), "until": None, "requests": int(row["requests"]), "strikes": int(row["strikes"]), "limited": seconds("limited_at"), "robots": value("robots_hash")}
        self._keep(s, timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "fetch_id"])
        purposes, hashes = (batch[c].astype(object).where(batch[c].notna(), None) for c in ("purpose", "robots_hash"))
        s, over = self._load(), []
        for event in zip(purposes, batch["status"].fillna(0).astype(int), batch["at"].astype(float), hashes, strict=True):
            if (until := self._until(s)) is not None and until <= event[2]:
                s["state"] = None
                over.append((key[0], s["gate"], None, s["strikes"], s["requests"], until))
            s = hosts.replay(iter([event]), s, self.config)
        self._keep(s, timerValues)
        yield _frame([*over, (key[0], s["gate"], s["state"], s["strikes"], s["requests"], float(batch["at"].iloc[-1]))], GATE_OUT)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000 + 0.001
        s = self._load()
        if s["limited"] is not None and s["limited"] + self.config.strike_hours * 3600 <= reached:
            self.limited.clear()
            s["limited"] = None
        if (until := s["until"]) is not None and until <= reached:
            s["state"] = s["until"] = None
            self._save(s)
            yield _frame([(key[0], s["gate"], None, s["strikes"], s["requests"], until)], GATE_OUT)

    def close(self) -> None:
        pass


class Retries(StatefulProcessor):
    """The place of a URL in the retry queue. State: ``queued`` (attempts, first failure, next attempt); timers at the next attempt and at the end of the time to live."""

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.timers = Timers(handle)
        self.queued = handle.getValueState("queued", "attempts int, first double, next double")

    def _pass(self, url: str, at: float, state: tuple) -> tuple[tuple, list[tuple]]:
        """The state at a time, and what happened until then: an attempt fell due, the time to live ended."""
        attempts, first, after = state
        out = []
        over = None if first is None else first + self.config.retry_ttl_hours * 3600
        if after is not None and after <= at and after <= over:
            out.append((url, attempts, after, None, "due"))
            after = None
        if over is not None and over <= at:
            out.append((url, attempts, over, None, "expired"))
            attempts, first, after = 0, None, None
        return (attempts, first, after), out

    def _keep(self, state: tuple, now: TimerValues) -> None:
        attempts, first, after = state
        self.timers.clear()
        if first is None:
            self.queued.clear()
            return
        self.queued.update(state)
        if after is not None:
            self.timers.set(after, now)
        self.timers.set(first + self.config.retry_ttl_hours * 3600, now)

    def _load(self) -> tuple:
        return self.queued.get() if self.queued.exists() else (0, None, None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        hours, out, state = self.config.retry_hours, [], self._load()
        batch = pd.concat(list(rows)).sort_values("at")
        for at, done in zip(batch["at"].astype(float), batch["finished"].fillna(False).astype(bool), strict=True):
            (attempts, first, _), passed = self._pass(key[0], at, state)
            out += passed
            if done or attempts >= len(hours):
                out.append((key[0], attempts, at, None, "finished" if done else "terminal"))
                state = 0, None, None
            else:
                state = attempts + 1, at if first is None else first, at + hours[attempts] * 3600
                out.append((key[0], state[0], at, state[2], "scheduled"))
        self._keep(state, timerValues)
        yield _frame(out, RETRY_OUT)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000 + 0.001
        state, out = self._pass(key[0], reached, self._load())
        self._keep(state, timerValues)
        if out:
            yield _frame(out, RETRY_OUT)

    def close(self) -> None:
        pass
