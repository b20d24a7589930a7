"""Spark-native building blocks for curating text corpora and building topic classifiers."""

from pyspark import cloudpickle

import topicweave as _self

# Helpers used inside Arrow tasks travel with the task itself, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(_self)
