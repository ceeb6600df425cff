"""Connected components and lookups by hot keys, which the near-duplicate operators share with the library's graphs."""

from __future__ import annotations

from trialweave.operators.graph import components, looked_up

__all__ = ["components", "looked_up"]
