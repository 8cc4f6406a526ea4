"""DataFrame -> DataFrame operators of the triage engine."""
