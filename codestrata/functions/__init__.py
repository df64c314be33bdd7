"""Column expressions: text in, text or arrays out, no shuffle and no Python workers."""
