"""Composed plans: the derived world, the bucketed triage table, reports, gates, progress."""
