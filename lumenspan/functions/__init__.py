"""Column expressions: JSON lookup, filters, record predicates and OTLP value conversion."""
