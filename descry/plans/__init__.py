"""The report plan and its sinks."""
