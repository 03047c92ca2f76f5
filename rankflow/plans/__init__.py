"""Plan shapes shared by the operators: written tables, group attach, ordered groups."""

from rankflow.plans.exact import exact_sums
from rankflow.plans.ordered import (
    previous_value,
    row_number,
    running_max,
    running_sum,
    split_groups,
)
from rankflow.plans.shared import attach, cut, new_path, shared_dir

__all__ = [
    "attach",
    "cut",
    "exact_sums",
    "new_path",
    "previous_value",
    "row_number",
    "running_max",
    "running_sum",
    "shared_dir",
    "split_groups",
]
