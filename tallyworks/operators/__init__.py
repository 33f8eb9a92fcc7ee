"""The analytics as functions from tables to lazy tables, for any number of tickers at once."""
