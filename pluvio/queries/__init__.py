"""Queries registered for the driver, grouped by theme."""

from importlib import import_module

THEMES = ["curation", "profiles", "sampling", "evaluation", "selection", "signal", "scale", "models"]


def all_registries():
    return [import_module(f"pluvio.queries.{theme}").REG for theme in THEMES]
