"""litlake: PySpark-native processing of research-literature collections.

Every public operator takes DataFrames and returns a DataFrame; nothing is
executed until the caller runs an action.  The subpackage ``litlake.llm``
(training-data operators) is optional: nothing outside it imports it.
"""

__version__ = "0.1.0"
