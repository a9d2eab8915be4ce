"""The operators over unbounded tables of pairs."""
