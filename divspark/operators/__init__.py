"""DataFrame -> DataFrame operators, each keyed by run-key columns ``keys``."""
