"""Relational operators: grouped rollouts, tables of counts, information theory, tests, landscapes, strata, audits, puzzles."""
