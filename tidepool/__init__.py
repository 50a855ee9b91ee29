"""Spark-native panel analytics: bars, signals, labels, folds, floors, statistics, books and gates as DataFrame operators."""
