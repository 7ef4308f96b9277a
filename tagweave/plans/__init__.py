"""End-to-end plans (evaluation, preference data, SFT data, reports) and the
driver query registry with its DuckDB oracle."""
