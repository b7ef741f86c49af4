"""The steps of a leaderboard study, each from DataFrames to DataFrames."""
