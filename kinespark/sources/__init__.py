"""Readers of recordings: episode directories, message files, and reports written before."""

from .discover import discover
from .recording import Recording, Stream

__all__ = ["Recording", "Stream", "discover"]
