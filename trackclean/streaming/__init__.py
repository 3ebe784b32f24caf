"""Row-only cleaning on streams."""
