"""The user-level results: elections, primaries, rosters, legislation, campaign finance and districts."""
