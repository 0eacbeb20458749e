"""grainmill: data preparation on Spark. Frames in, lazily planned frames out.

Function names say what is processed and what comes out: df_* take frames, col_* a column of one,
array_* array-like columns, dic_* dictionaries.
"""

from grainmill.operators.clean import col_check_allsame, col_drop_outliers, df_count_uniques, df_drop_duplicates, df_drop_nancols, df_drop_nanrows, df_drop_weak, df_find_nan, is_number, max_category, nan_dropper, string_contains_to_binary
from grainmill.operators.columns import col_move_place, col_to_split, datetime_detector, datetime_handler, datetime_to_sequence, df_clean_colnames, df_drop_col, df_rename_col, df_rename_cols, df_restructure_values, df_to_dfs, df_to_xy, int_to_chars, multi_input_support, transform_data
from grainmill.operators.corr import col_corr_ols, df_corr_any, df_corr_extratrees, df_corr_ols, df_corr_pearson, df_corr_randomforest
from grainmill.operators.dictops import dic_corr_perc, dic_count_complexity, dic_resample_values
from grainmill.operators.group import col_corr_category, col_groupby_cdf, col_groupby_pdf, col_groupby_stats, col_resample_interval, col_to_cols, df_groupby_params, df_print_values, df_to_groupby, groupby_func
from grainmill.operators.joins import df_merge
from grainmill.operators.sample import array_random_shuffle, array_random_weighted, array_split, array_to_generator, array_to_kfold, col_resample_equal, df_resample_id, df_resample_stratified
from grainmill.operators.tensors import array_reshape_conv1d, array_reshape_lstm
from grainmill.operators.transform import array_detect_task, array_to_multilabel, col_fill_nan, col_impute_nan, col_rescale_max, col_to_biclass, col_to_binary, col_to_buckets, col_to_multilabel, df_add_scorecol, df_fill_empty, df_impute_nan, df_rescale_log, df_rescale_meanzero, df_rescale_sqrt, df_to_lower, df_to_multiclass, df_to_multilabel, df_to_numeric, filling_nans, imputing_nans, starts_with_output, to_category_labels, value_starts_with
from grainmill.operators.udf import df_parallelize_process
from grainmill.sources.tables import create_datetime_col, create_synth_data, create_time_sequence, read_large_csv
from grainmill.streaming.resample import stream_resample_interval

shuffle = array_random_shuffle


def df_to_binary(data, y, destructive=False):
    """Gone: col_to_binary does this."""
    raise NotImplementedError("use col_to_binary")


__all__ = sorted(k for k, v in globals().items() if callable(v) and not k.startswith("_"))
