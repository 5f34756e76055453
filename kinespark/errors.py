"""What can go wrong, by whose fault."""

from __future__ import annotations


class SourceError(ValueError):
    """A recording, or a part of it that a rule needs, cannot be read."""


class UnsupportedSource(SourceError):
    """No reader knows this kind of source."""


class ConfigError(ValueError):
    """A configuration, baseline, plugin or option is not valid."""


class NotApplicable(Exception):
    """A rule has nothing to say about this recording; the text says why."""
