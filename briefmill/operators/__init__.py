"""operators of the document-review engine."""
