"""Skeinflow: conversational fact analytics on Spark."""
