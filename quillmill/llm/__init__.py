"""Training-data operators: text in documents, pages and conversations in, whole results out.

Nothing outside this package imports it.  ``registry`` lists its queries.
"""
