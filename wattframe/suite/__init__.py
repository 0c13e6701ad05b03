"""Registered queries over the standard tables, each with an equivalent SQL text where SQL can express it."""

from importlib import import_module

MODULES = ("tables", "cleaning", "shapes", "relations", "panels", "calendars", "evaluation",
           "forecasts", "decompositions", "resources", "checks", "jobs")


def load() -> None:
    for module in MODULES:
        import_module(f"wattframe.suite.{module}")
