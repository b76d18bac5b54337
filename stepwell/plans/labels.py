"""Plan labels: builds and flags written as one string, and read back."""

from __future__ import annotations

from typing import NamedTuple

ALL = "all"
#: Flags in the order they are appended; the goal list's name may follow :goals.
FLAGS = (("quality_only", ":good"), ("strict", ":strict"), ("list_only", ":list"), ("goals", ":goals"), ("beginner", ":beginner"), ("unblock", ":unblock"), ("relax", ":relax"))


class Plan(NamedTuple):
    builds: tuple[str, ...] = ()
    quality_only: bool = False
    strict: bool = False
    list_only: bool = False
    goals: bool = False
    goal_list: str = ""
    beginner: bool = False
    unblock: bool = False
    relax: bool = False


def write(plan: Plan) -> str:
    out = "+".join(plan.builds) or ALL
    for name, flag in FLAGS:
        if getattr(plan, name):
            out += flag + (f":{plan.goal_list}" if name == "goals" and plan.goal_list else "")
    return out


def read(label: str) -> Plan:
    """The settings a label carries: flags are taken off its end, last first, so that a build's own colon stays."""
    found: dict = {}
    for name, flag in reversed(FLAGS):
        if name == "goals" and f"{flag}:" in label:
            label, found["goal_list"] = label.split(f"{flag}:", 1)
            found["goals"] = True
        elif label.endswith(flag):
            label = label.removesuffix(flag)
            found[name] = True
    return Plan(builds=() if label == ALL else tuple(label.split("+")), **found)


def stored(wanted: list[str], have: set[str]) -> str | None:
    """The first wanted label that is stored."""
    return next((x for x in wanted if x in have), None)
