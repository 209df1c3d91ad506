"""Sources and sinks: raw tables, the test-data binding, the warehouse."""

from marketlens.sources.raw import load_raw, read_raw_csv  # noqa: F401
from marketlens.sources.warehouse import (  # noqa: F401
    latest_run,
    load_fact,
    read_fact,
    read_runs,
    record_run,
    write_star,
)
