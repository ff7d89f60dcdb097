"""Peer-comparison analytics over filings, facts and graphs on Spark."""
