"""Reading tables and texts, and keeping versions, views and chart data."""
