"""Training-data operators: near-duplicate joins, filters, classifiers, writers and mixers on Spark."""
