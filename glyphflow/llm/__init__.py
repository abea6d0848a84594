"""Operators for training-data corpora.

One module per operator; ``queries.py`` registers the query of each.  Nothing
outside this folder imports it, and it imports nothing of the rest of the
package, so it can be removed as a whole.
"""
