"""Operators over the job, photo, cluster and export tables; each takes DataFrames and returns one."""
