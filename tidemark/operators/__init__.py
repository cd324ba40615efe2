"""Datalog clauses, aggregates, windows, rules and temporal reduction as DataFrame plans."""
