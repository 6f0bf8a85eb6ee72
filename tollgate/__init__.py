"""tollgate: Spark-native analytics for a timed internet-access business.

Packages, payments, sessions and usage logs are DataFrames; every report,
state transition and data-quality check is a DataFrame job that Catalyst
plans and Spark distributes.  See README.md for the operator inventory.
"""

__version__ = "0.1.0"
