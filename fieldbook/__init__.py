"""Fieldbook: Spark jobs for incident-style tables."""
