"""Connected components of candidate links."""

from __future__ import annotations

from ..operators.graph import components, tree_roots

__all__ = ["components", "tree_roots"]
