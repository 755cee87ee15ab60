"""sosrank: outcome-rate analytics adjusted for strength of schedule, on Spark.

Inputs are three DataFrames (see ``sosrank.schemas``):

* ``contests``    fact table, one row per contest (attacker, defender, winner, ...)
* ``competitors`` dimension, one row per competitor (name, grp, strength, ...)
* ``matchups``    group-by-group multiplier matrix in long form

Everything is written with the DataFrame API and built-in functions so the
work stays on the executors; no Python UDFs, no driver loops.
"""

__version__ = "0.1.0"
