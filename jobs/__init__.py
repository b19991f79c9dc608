"""Runnable jobs over the library's operators. Each module has a function ``run`` that takes a session and a
configuration, and a command line."""
