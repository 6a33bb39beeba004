"""Training-data operators: each module holds one operator with its own general
interface; ``queries`` registers the thin ``opN_*`` queries over ``documents``.

Nothing else in the library imports this subpackage.
"""
