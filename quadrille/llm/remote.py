"""Sending Arrow functions to Python workers.

``remote`` returns a closure that imports its target by name on the worker, after putting this
installation on the path; so a worker started elsewhere on the same file system finds the package.
"""

from __future__ import annotations

from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])


def remote(module: str, name: str, **options):
    root = ROOT

    def call(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(batches, **options)

    return call
