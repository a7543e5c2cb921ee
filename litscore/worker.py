"""What a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types


def worker_state() -> dict:
    """A dictionary that lives as long as the worker process.

    Functions sent by value get fresh module globals with every task; what is costly to
    load is kept here instead, under a key of the caller's choice.
    """
    name = "litscore_worker_state"
    module = sys.modules.get(name)
    if module is None:
        module = sys.modules[name] = types.ModuleType(name)
        module.kept = {}
    return module.kept
