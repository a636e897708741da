"""Training-data operators over document tables (one module per operator).

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries.
"""
