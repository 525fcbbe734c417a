"""Operators of a training-data pipeline. Nothing outside this package imports it but the driver's entry module."""

from importlib import import_module

MODULES = ("urls", "token_files", "packing", "quality", "bpe", "ngrams", "simhash", "ann", "pii", "pages", "licenses", "runs", "variants")


def load():
    """Import the operator modules once and hand out their registry."""
    for name in MODULES:
        import_module(f"veilspan.llm.{name}")
    return import_module("veilspan.llm.common")
