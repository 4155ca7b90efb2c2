"""Sources and adapters."""
