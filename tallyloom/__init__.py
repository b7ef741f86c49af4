"""tallyloom: leaderboard analytics and corpus operations on Spark DataFrames."""
