"""Sources and sinks: job exports, the driver fixture views, the report library."""
