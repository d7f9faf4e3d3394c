"""Training-data operators: one module per operator, registered in ``queries``.

Nothing else in the library imports this subpackage.
"""
