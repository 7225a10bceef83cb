"""Runnable jobs: each module has run(spark, ...) and a command line (python -m jobs.NAME --help)."""
