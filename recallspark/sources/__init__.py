"""Sources and sinks: record logs, index tables, embedding services."""
