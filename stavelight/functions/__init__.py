"""Row-local expressions and fixed values."""
