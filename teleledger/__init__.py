"""Set-at-a-time analytics over television viewing and recording logs, on Spark."""
