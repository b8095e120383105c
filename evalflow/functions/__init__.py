"""Column expressions: text and JSON extraction, dialect tags, names, templates, tokens."""
