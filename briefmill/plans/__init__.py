"""plans of the document-review engine."""
