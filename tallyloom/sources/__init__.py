"""Readers of leaderboards and writers of results."""
