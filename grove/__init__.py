"""grove: incremental random forests and their companions as Spark jobs.

Sub-packages:

* ``sources``   - table, CSV and numbered-batch readers, model store, metrics sink
* ``functions`` - Column builders: reproducible hashing, impurity, probabilities
* ``operators`` - preparation, sampling, candidate splits, histograms, growth,
                  update, scoring, inspection, evaluation, statistics, logistic
* ``plans``     - fixtures on the supplied tables and the registered queries
* ``streaming`` - micro-batch model updates with Structured Streaming
"""

__version__ = "0.1.0"
