"""Event-graph risk analytics as lazy, set-at-a-time Spark DataFrame operators."""
