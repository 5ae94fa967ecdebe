"""Keeps a normalised media catalogue and viewers' lists up to date from JSON documents, on Spark."""
