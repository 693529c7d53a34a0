"""Where telemetry goes: partitioned tables, retention and OTLP/JSON export documents."""
