"""Queries over the tables of a data directory, each with the SQL that checks it where SQL can."""
