"""DuckDB texts of the adapter views and of every query that plain SQL can express."""
