"""Jobs that compose operators end to end (one lazy DAG per job)."""
