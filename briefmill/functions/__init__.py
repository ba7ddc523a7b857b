"""functions of the document-review engine."""
