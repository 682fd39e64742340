"""treelens: a Spark-native auditor of source trees and text corpora."""

__version__ = "0.1.0"
