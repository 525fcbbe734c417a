"""Registered queries, one module per section of the operator list."""

from importlib import import_module

MODULES = ("detect", "redaction", "leaks", "scoring", "training", "access", "io")


def load():
    """Import every module once and hand out the registry."""
    for name in MODULES:
        import_module(f"veilspan.plans.{name}")
    return import_module("veilspan.plans.base")
