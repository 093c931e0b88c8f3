"""The registered queries, by the part of the engine they use."""

from importlib import import_module

MODULES = ("geo", "gen", "join", "fsm", "agg", "win", "names", "px", "stream", "flight", "catalogue", "carry", "readers", "reports", "monitor")
for _name in MODULES:
    import_module(f"{__name__}.{_name}")
