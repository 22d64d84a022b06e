"""Reading raw tables, writing results, and raw tables shaped from other data."""
