"""Tessera: workflow, event-log and corpus analytics on Spark."""
