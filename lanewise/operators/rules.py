"""The rules of evidence, health, peak memory and budgets, one step each."""

from __future__ import annotations

from lanewise.operators.folds import Event, Rule, State, Stepped
from lanewise.plans.policy import DEFAULT, Policy

LEASE, RESULT, EXPIRY = 0, 1, 2


def _lease_step(state: State | None, e: Event) -> Stepped:
    state = state or {"leases": {}, "digests": {}, "accepted": None}
    leases, digests = dict(state["leases"]), dict(state["digests"])
    batch, out, later = e["batch"], [], []

    def say(outcome: str) -> None:
        out.append({"batch": batch, "at": e["at"], "outcome": outcome})

    if e["kind"] == LEASE:
        if batch not in leases:
            leases[batch] = e["expires"]
            later.append({"at": e["expires"], "kind": EXPIRY, "batch": batch, "digest": None, "expires": None})
    elif e["kind"] == EXPIRY:
        if state["accepted"] is None:
            say("expired")
    elif batch not in leases:
        say("unknown")
    elif batch in digests:
        if digests[batch] != e["digest"]:
            raise ValueError(f"the result of batch {batch} was altered after it was taken in")
        say("duplicate")
    else:
        digests[batch] = e["digest"]
        if state["accepted"] is not None:
            say("superseded")
        else:
            state = state | {"accepted": batch}
            say("accepted" if e["at"] <= leases[batch] else "accepted_late")
    return Stepped({"leases": leases, "digests": digests, "accepted": state["accepted"]}, out, later)


# A task's leases and results: the first result of a leased batch stands, whether its lease has
# expired or not, and nothing later overwrites it; a batch taken in must not change.
LEASED = Rule(
    _lease_step, ("at", "kind", "batch", "digest"), "at timestamp, kind int, batch string, digest string, expires timestamp",
    "leases map<string,timestamp>, digests map<string,string>, accepted string", "batch string, at timestamp, outcome string",
)


def health(policy: Policy = DEFAULT) -> Rule:
    """A name's DEAD state by run, as ``states.dead_states``; a run not after the last is ignored."""

    def step(state: State | None, e: Event) -> Stepped:
        s = state or {"url": None, "streak": 0, "began": None, "dead": False, "run": None}
        if s["run"] is not None and e["run"] <= s["run"]:
            return Stepped(s, [], [])
        url, streak, began, dead = s["url"], s["streak"], s["began"], s["dead"]
        if e["url"] != url or e["status"] != "UNKNOWN":
            streak, began, dead = 0, None, False
        if e["status"] == "UNKNOWN" and not e["circuit"]:
            streak += 1
            began = began or e["at"]
            dead = dead or (streak >= policy.dead_after_runs and (e["at"] - began).total_seconds() >= policy.dead_min_age_hours * 3600)
        effective = e["status"] if e["status"] != "UNKNOWN" else "DEAD" if dead else "UNKNOWN"
        out = {"run": e["run"], "at": e["at"], "status": e["status"], "streak": streak, "effective": effective}
        return Stepped({"url": e["url"], "streak": streak, "began": began, "dead": dead, "run": e["run"]}, [out], [])

    return Rule(
        step, ("at", "run"), "at timestamp, run long, url string, status string, circuit boolean",
        "url string, streak int, began timestamp, dead boolean, run long", "run long, at timestamp, status string, streak int, effective string",
    )


def _peak_step(state: State | None, e: Event) -> Stepped:
    held = state
    if e["peak"] and not e["circuit"]:
        if e["status"] == "BAD" and e["confirmed"]:
            held = {"url": e["url"], "failed": e["at"]}
        elif e["status"] == "GOOD" and held and held["url"] == e["url"]:
            held = None
    changed = held != state
    out = [{"at": e["at"], "url": (held or state)["url"], "failed": held["failed"] if held else None}] if changed else []
    return Stepped(held, out, [])


# Failures confirmed in the evening are remembered until the same URL is good in an evening;
# an output row tells that the memory was set (``failed``) or cleared (null).
PEAK = Rule(
    _peak_step, ("at", "url", "status"), "at timestamp, url string, status string, confirmed boolean, peak boolean, circuit boolean",
    "url string, failed timestamp", "at timestamp, url string, failed timestamp",
)

RESERVE, SETTLE = 0, 1


def budget(policy: Policy = DEFAULT) -> Rule:
    """One account's day: reservations admitted while they fit, each settled once.

    A reservation is charged in full and refused with the first limit it would pass. Settling
    refunds what was not used, except after an interruption; settling again, or settling what
    was never reserved, changes nothing; nor does reserving a batch again.
    """

    def step(state: State | None, e: Event) -> Stepped:
        s = state or {"amount": 0, "seconds": 0, "candidates": 0, "found_amount": 0, "found_seconds": 0, "open": {}, "seen": {}}
        s = s | {"open": dict(s["open"]), "seen": dict(s["seen"])}
        batch, amount, seconds, candidates = e["batch"], e["amount"], e["seconds"], e["candidates"] or 0
        if e["kind"] == RESERVE:
            if batch in s["seen"]:
                outcome = "repeated"
            elif s["amount"] + amount > policy.daily_amount:
                outcome = "daily_byte_budget"
            elif s["seconds"] + seconds > policy.daily_seconds:
                outcome = "daily_time_budget"
            elif s["candidates"] + candidates > policy.daily_candidates:
                outcome = "daily_candidate_budget"
            elif candidates and (s["found_amount"] + amount > policy.discovery_amount or s["found_seconds"] + seconds > policy.discovery_seconds):
                outcome = "discovery_budget"
            else:
                outcome = "reserved"
                s["amount"] += amount
                s["seconds"] += seconds
                s["candidates"] += candidates
                if candidates:
                    s["found_amount"] += amount
                    s["found_seconds"] += seconds
                s["open"][batch] = [amount, seconds, candidates]
                s["seen"][batch] = True
        elif batch not in s["open"]:
            outcome = "ignored"
        else:
            held_amount, held_seconds, held_candidates = s["open"].pop(batch)
            outcome = "interrupted" if e["interrupted"] else "settled"
            if not e["interrupted"]:
                back, back_seconds = max(0, held_amount - amount), max(0, held_seconds - seconds)
                s["amount"] -= back
                s["seconds"] -= back_seconds
                if held_candidates:
                    s["found_amount"] -= back
                    s["found_seconds"] -= back_seconds
        out = {"batch": batch, "at": e["at"], "outcome": outcome, "spent": s["amount"], "spent_seconds": s["seconds"]}
        return Stepped(s, [out], [])

    return Rule(
        step, ("at", "kind", "batch"), "at timestamp, kind int, batch string, amount long, seconds long, candidates int, interrupted boolean",
        "amount long, seconds long, candidates int, found_amount long, found_seconds long, open map<string,array<long>>, seen map<string,boolean>",
        "batch string, at timestamp, outcome string, spent long, spent_seconds long",
    )
