"""Query suites and the SQL front end."""
