"""lumisift: light-curve triage, evidence tables and training-data operators as Spark DataFrame jobs."""
