"""Operators: set-based reads (directory, learning, billing, notices, access),
change batches (changes) and the routes declared without a body (declared)."""
