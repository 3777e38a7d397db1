"""DataFrame -> DataFrame operators of the triage workflow."""
