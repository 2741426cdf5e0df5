"""Training-data operators for very large corpora.

Nothing outside this subpackage imports it.  Every module offers one
operator with its own general interface; ``queries`` registers the thin
``opN_*`` queries (and the pipeline) for the driver.
"""
