"""Sources and sinks, and the views that present general tables as tracking tables."""
