"""marketlens: marketplace order analytics as Spark DataFrame operators.

Raw order tables become a star schema (``sources`` + ``operators.star``),
and every analysis is a ``DataFrame -> DataFrame`` operator over the
prepared fact (``operators.*``). Batch jobs that materialise the star and the
analysis marts live in ``plans``. All heavy work is Spark SQL / DataFrame /
Spark ML; Python only orchestrates.
"""

__version__ = "0.1.0"
