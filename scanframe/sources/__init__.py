"""Sources of files and reports, and the sinks of findings."""
