"""Versioned, bitemporal facts as ordinary Spark DataFrames.

Every public function takes and returns DataFrames; nothing here runs a job
unless its docstring says so.
"""

__version__ = "0.1.0"
