"""streaming of the document-review engine."""
