"""Column expressions: everything here takes and returns ``Column``."""
