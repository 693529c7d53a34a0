"""Where telemetry comes from: OTLP/JSON exports, stored tables and mappings from other tables."""
