from gaugeline.functions.columns import (  # noqa: F401
    HOUR_US,
    binary_label,
    blank_to_null,
    clamp,
    col,
    decompose,
    exceeds,
    exceeds_or_zero,
    file_safe,
    finite,
    first_integer,
    floor_negative,
    hour_of_year,
    in_time_range,
    keep_within,
    leading_number,
    nan_to_null,
    parse_time,
    round_hour,
    round_half_even,
    row_flag,
    season_keys,
    sentinels_to_null,
    to_number,
    to_number_comma,
)
