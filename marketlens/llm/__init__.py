"""Training-data pipeline operators (dedup, decontamination, mixing, scoring, search).

Each module holds one operator with its own interface; ``queries`` binds them
to the test tables. Nothing outside this package imports it. Functions of the
package that run on executors are pickled by value, so workers need no
installed copy of it.
"""

from pyspark.cloudpickle import register_pickle_by_value

import marketlens.llm as _package

register_pickle_by_value(_package)
