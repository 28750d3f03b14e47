"""Runnable jobs over the library; each has a command line, a config file and a function taking a session."""
