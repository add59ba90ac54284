"""scorelens: model-output diagnostics as DataFrame operations."""

__version__ = "0.1.0"
