"""Plans: guarded SQL and steps proposed from a profile."""
