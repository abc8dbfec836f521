"""Spark jobs that turn landed game logs into scored player-days, ledgers and boards."""
