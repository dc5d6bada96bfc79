"""Mendlist: review prioritisation as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and stays lazy
unless its docstring names the one small report it reads on the driver.
"""
