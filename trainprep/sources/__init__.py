"""Sources and sinks."""

from trainprep.sources.io import Source, SourceRegistry  # noqa: F401
