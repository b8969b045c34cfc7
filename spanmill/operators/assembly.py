"""Actions put together from events by ordered emitters, each of which leaves fewer events for the next.

An emitter is data: which events it starts from, what keeps it from doing so, which
events around it the action covers, and whether it is a fallback. Stages follow
each other; within a stage events come in time order and the first emitter that
fits takes the event. An event that an action covers starts no other one. Events
further apart than every reach cannot meet, so that a case is split into sessions
of touching events, and each session is worked on by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sweeps import sessions, swept

ACTIONS = "case_id long, action string, event_id long, s long, e long, covered array<long>, hidden_by string"


@dataclass(frozen=True)
class Near:
    """Events of some channels (all, if none is given) of a least value that overlap by a share of the shorter or lie within a gap."""

    channels: tuple[str, ...] = ()
    least_overlap: float = 1.1
    most_gap: int = -1
    least_value: float = float("-inf")

    def holds(self, a: dict, b: dict) -> bool:
        """Whether b is near a."""
        if (self.channels and b["channel"] not in self.channels) or b["value"] < self.least_value:
            return False
        shared = max(0, min(a["e"], b["e"]) - max(a["s"], b["s"]) + 1)
        shorter = min(a["e"] - a["s"], b["e"] - b["s"]) + 1
        apart = max(0, max(a["s"], b["s"]) - min(a["e"], b["e"]) - 1)
        return shared / shorter >= self.least_overlap or apart <= self.most_gap


@dataclass(frozen=True)
class Emitter:
    """One kind of action and when it is emitted."""

    action: str
    channels: tuple[str, ...] = ()
    least_value: float = float("-inf")
    most_value: float = float("inf")
    needs: tuple[Near, ...] = ()  # each has to be near
    unless: tuple[Near, ...] = ()  # one of these keeps the event from any emitter of the stage
    covers: tuple[Near, ...] = ()
    fallback: bool = False  # dropped if what it starts from is covered by actions that are no fallbacks

    def fits(self, event: dict) -> bool:
        """Whether the event by itself can start the action."""
        return (not self.channels or event["channel"] in self.channels) and self.least_value <= event["value"] <= self.most_value

    def reach(self) -> int:
        """How far it looks."""
        return max([0, *(n.most_gap for n in (*self.needs, *self.unless, *self.covers))])


def _assembled(events: list[dict], stages: list[list[Emitter]], dominance: dict[str, tuple[str, ...]], least_overlap: float) -> list[dict]:
    """The actions of one session's events in time order."""
    covered: set[int] = set()
    actions: list[tuple[Emitter, dict, list[int]]] = []
    around = lambda at, near: (k for k, other in enumerate(events) if k != at and near.holds(events[at], other))
    for stage in stages:
        for at, event in enumerate(events):
            if at in covered:
                continue
            for emitter in stage:
                if not emitter.fits(event) or not all(any(True for _ in around(at, n)) for n in emitter.needs):
                    continue
                if any(any(True for _ in around(at, n)) for n in emitter.unless):
                    break
                own = sorted({at, *(k for n in emitter.covers for k in around(at, n))})
                covered.update(own)
                actions.append((emitter, event, own))
                break
    explained = {k for emitter, _, own in actions if not emitter.fallback for k in own}
    kept = [(em, ev, own) for em, ev, own in actions if not (em.fallback and events.index(ev) in explained)]
    out = []
    for emitter, event, own in kept:
        over = [em.action for em, ev, _ in kept if emitter.action in dominance.get(em.action, ()) and Near(least_overlap=least_overlap).holds(event, ev)]
        out.append({"case_id": event["case_id"], "action": emitter.action, "event_id": event["event_id"], "s": event["s"], "e": event["e"], "covered": [events[k]["event_id"] for k in own], "hidden_by": over[0] if over else None})
    return out


def assembled(events: DataFrame, stages: list[list[Emitter]], dominance: dict[str, tuple[str, ...]] | None = None, least_overlap: float = 0.2) -> DataFrame:
    """(case_id, action, event_id, s, e, covered, hidden_by) of events (case_id, event_id, channel, s, e, value).

    ``dominance`` names, for an action, those that it hides where they overlap by
    ``least_overlap`` of the shorter; the first one in time hides. Events are taken by
    start, end, id. A null value or channel fits no test of it. No events give no actions.
    """
    reach = max([0, *(em.reach() for stage in stages for em in stage)])
    own = events.select("case_id", "event_id", F.coalesce("channel", F.lit("")).alias("channel"), "s", "e", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    cut = sessions(own, ["case_id"], reach + 1, ["s", "e", "event_id"])
    return swept(cut, ["case_id", "session"], ["s", "e", "event_id"], lambda rows: _assembled(rows, stages, dominance or {}, least_overlap), ACTIONS)


def residual(events: DataFrame, actions: DataFrame) -> DataFrame:
    """The events that no action covers."""
    taken = actions.select(F.explode("covered").alias("event_id")).distinct()
    return events.join(taken, "event_id", "left_anti")
