"""The query modules of the core."""

from __future__ import annotations

from types import ModuleType

from tagweave.queries import frames, labels, operations, quality


def modules() -> list[ModuleType]:
    return [quality, labels, frames, operations]
