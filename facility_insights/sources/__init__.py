"""Sources and sinks: file scans, the shape views, and written intermediate tables."""

from . import files, shapes  # noqa: F401
