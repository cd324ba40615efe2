"""Where facts come from: relations, fact logs, written intermediate tables."""
