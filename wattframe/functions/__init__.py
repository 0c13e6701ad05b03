"""Column-level functions: no shuffle, usable inside any select."""
