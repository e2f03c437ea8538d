"""The engine's public names in one place."""

from stratabar.functions.intervals import STANDARD_INTERVALS, TimeInterval, bin_start, parse_interval
from stratabar.functions.timestamps import (
    TimestampFormat, detect_timestamp_format, fix_timestamp_display, normalize_timestamp_to_datetime, restore_original_timestamp_format,
)
from stratabar.operators.dollarbars import (
    aggregate_trades_to_dollar_bars_dynamic, aggregate_trades_to_dollar_bars_fixed, calculate_daily_dollar_volume, calculate_dynamic_threshold,
    calculate_ema_daily_volume, dynamic_thresholds,
)
from stratabar.operators.imbalance import aggregate_trades_to_dollar_imbalance_bars, aggregate_trades_to_tick_imbalance_bars, calculate_tick_rule
from stratabar.operators.resample import DEFAULT_OHLCV_COLUMNS, OHLCVAggregator, aggregate_ohlcv, detect_source_interval
from stratabar.operators.timebars import aggregate_trades_from_file, aggregate_trades_to_ohlcv
from stratabar.operators.validate import ValidationResult, compare_dataframes, print_validation_results, validate_aggregation_accuracy, validate_row_counts
from stratabar.operators.stats import average_rank, cast_or_keep, row_slice, summary
from stratabar.schemas import DataType, Frequency, Market, get_data_config, get_data_type_schema, to_candle_names
from stratabar.session import get_session
from stratabar.sources.catalog import (
    ArchiveRepository, DataConfig, date_list, determine_optimal_frequency, file_urls, get_data_frequency, get_file_extension, missing_files, parse_date_range, parse_listings, smart_catalog,
)
from stratabar.sources.ingest import (
    compact, ingest_archives, process_csv_to_parquet, process_downloaded_files, process_zip_to_parquet, read_archives, read_csv, write_parquet,
)
from stratabar.streaming.bars import stream_dollar_bars, stream_imbalance_bars, stream_time_bars

__all__ = [name for name in dir() if not name.startswith("_")]
