"""DataFrame -> DataFrame operators (statistics, scoring, ranking, linking, evaluation)."""
