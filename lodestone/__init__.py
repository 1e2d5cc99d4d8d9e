"""lodestone: a Spark-native engine for code-graph retrieval and corpus analytics.

Everything is a DataFrame, SQL or window plan that Catalyst can optimise; Python
runs only where text has to be lexed, embedded or bit-packed, and then on Arrow
batches.
"""

__version__ = "0.1.0"
