"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``queries`` in
``pitlake.llm.registry`` lists what it offers to the driver.
"""
