"""The registered queries, by part."""

from . import growth, matching, profiles  # noqa: F401
