"""Shared scratch space of the operators."""

from claimweave.sources.scratch import dropped, new_path, shared_dir, stored

__all__ = ["dropped", "new_path", "shared_dir", "stored"]
