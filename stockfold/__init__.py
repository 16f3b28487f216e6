"""Event-sourced stock ledgers on Spark."""
