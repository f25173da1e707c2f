"""Evidence analytics for coded incidents, expressed as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame, works on all cases at once and leaves the choice of
physical strategy to Catalyst and adaptive execution.
"""
