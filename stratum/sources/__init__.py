"""Readers of public datasets, from files that were fetched before: each normalises what a provider publishes."""
