"""sources of the document-review engine."""
