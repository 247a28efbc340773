"""Training-data operators. Nothing else in the package imports this subpackage.

``QUERIES`` and ``ORACLES`` (see ``registry``) hold the registered queries and their SQL.
"""
