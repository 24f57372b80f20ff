from .bronze import CORRUPT, read_bronze, sample
from .tables import (
    ContractError,
    cached,
    cluster_by,
    current_root,
    gold_is_empty,
    gold_status,
    load_gold,
    move_catalogs,
    publish_run,
    read_table,
    register_gold,
    remove_abandoned,
    run_root,
    table_path,
    write_table,
)

__all__ = [
    "CORRUPT",
    "ContractError",
    "cached",
    "cluster_by",
    "current_root",
    "gold_is_empty",
    "gold_status",
    "load_gold",
    "move_catalogs",
    "publish_run",
    "read_bronze",
    "read_table",
    "register_gold",
    "remove_abandoned",
    "run_root",
    "sample",
    "table_path",
    "write_table",
]
