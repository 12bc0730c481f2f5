"""Table operators: every one takes and returns a DataFrame."""

from loomframe.operators.arrange import arrange
from loomframe.operators.checks import check_order_key, check_shape, join_relation
from loomframe.operators.dominance import join_inequalities
from loomframe.operators.grid import complete, expand_grid, gap_runs, missing_cells
from loomframe.operators.grouped import (
    filter_at_max,
    fit_per_column,
    fit_per_group,
    keep_groups_all,
    keep_groups_missing_below,
    reframe_quantiles,
    slice_head,
    slice_max,
    summarise_columns,
)
from loomframe.operators.hot import join_hot_keys
from loomframe.operators.joins import (
    join_closest,
    join_inequality,
    join_overlap,
    join_per_group,
    join_within,
    left_join,
    right_join,
    stack_rows,
)
from loomframe.operators.models import fit_linear
from loomframe.operators.nest import (
    Reduction,
    group_apply,
    group_reduce,
    nest,
    nest_parts,
    unnest,
)
from loomframe.operators.reshape import (
    pivot_longer,
    pivot_wider,
    separate_delim,
    separate_position,
)
from loomframe.operators.scan import (
    Steps,
    accumulate,
    accumulate_affine,
    chain_index,
    clamped,
    record_id,
)
from loomframe.operators.select import (
    drop_matching_rows,
    drop_positions,
    filter_if_all,
    filter_if_any,
    filter_not_any,
    mutate_across,
    numeric,
    positions,
    scale_columns,
    starts_with,
    summarise_across,
    textual,
)
from loomframe.operators.selection import select_quantiles
from loomframe.operators.windows import (
    Mergeable,
    center,
    cumprod,
    cumsum,
    dense_rank,
    first_last,
    fixed_base_change,
    lag,
    lag_change,
    min_rank,
    period_set_change,
    rolling,
    rolling_list,
    row_number,
    standardise,
)

from loomframe.plans.blocks import WHOLE_GROUPS
from loomframe.plans.matching import attach_group_stats, keep_groups

__all__ = ["WHOLE_GROUPS", *[n for n, v in list(globals().items()) if callable(v)]]
