"""Column functions: text, entities, tokens. No Python runs per row."""
