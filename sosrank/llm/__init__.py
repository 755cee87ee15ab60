"""Operators of a training-data pipeline over ``documents`` and ``pages``.

One module per operator; ``entry_queries`` maps each registered query to its operator.
Nothing else in the library imports this package.
"""
