"""leakscope: personal-data exposure analytics on Spark DataFrames.

Documents go in as a table or a stream, findings come out as rows, and every rollup (exposure score, scan summary,
distribution, alert window, report) is a DataFrame built from those rows.
"""
__version__ = "0.1.0"
