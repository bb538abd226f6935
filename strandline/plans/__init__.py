"""Registered queries: one per operator, each with its SQL check where SQL can state it."""
