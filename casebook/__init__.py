"""casebook: support-ticket text analytics as Spark DataFrame operators.

Subpackages:
  functions  Column -> Column building blocks (cleaning, terms, rules, scoring)
  operators  DataFrame -> DataFrame operators (conversations, retrieval, ranking,
             examples, prompting, timelines, logs, gap analysis)
  sources    readers for the file shapes the operators consume
  sinks      writers for the results
  plans      registered driver jobs (one per operator family) and their oracles
  streaming  micro-batch runner for incrementally arriving tickets
"""

__version__ = "0.1.0"
