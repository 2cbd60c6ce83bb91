"""Runnable jobs: each module has run(spark, ...) for a session that is there, and a command line that makes one."""
