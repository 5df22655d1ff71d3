"""The query catalogue: every query and, where SQL can express it, its SQL for the oracle."""
