"""Sources and sinks (OP-01..03) and the corpora derived from the driver tables."""
