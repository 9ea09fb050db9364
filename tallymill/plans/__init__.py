"""Compositions of jobs and the sample tables they are checked on."""
