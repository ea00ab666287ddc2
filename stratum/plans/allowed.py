"""What a query may be made of: parser nodes, functions and table functions; anything else is refused."""

NODES = frozenset(
    """
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot
    Project RepartitionByExpression Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition
    """.split()
)

#: Of the analysed plan; leaves are checked one by one.
LEAVES = frozenset("LocalRelation OneRowRelation Range CTERelationRef UnionLoopRef LogicalRDD LogicalRelation DataSourceV2Relation ExternalRDD".split())

TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack variant_explode variant_explode_outer json_tuple".split())

#: No reflection, no files, no schemas or stylesheets read from paths, nothing about the session's user or catalog.
FUNCTIONS = frozenset(
    """
    abs acos acosh add_months aes_decrypt aes_encrypt aggregate and any any_value approx_count_distinct approx_percentile approx_top_k approx_top_k_accumulate
    approx_top_k_combine approx_top_k_estimate array array_agg array_append array_compact array_contains array_distinct array_except array_insert array_intersect array_join
    array_max array_min array_position array_prepend array_remove array_repeat array_size array_sort array_union arrays_overlap arrays_zip ascii asin asinh atan atan2 atanh
    avg base64 between bigint bin binary bit_and bit_count bit_get bit_length bit_or bit_xor bitmap_and_agg bitmap_bit_position bitmap_bucket_number bitmap_construct_agg
    bitmap_count bitmap_or_agg bool_and bool_or boolean bround btrim cardinality cast cbrt ceil ceiling char char_length character_length chr coalesce collate collation
    collect_list collect_set concat concat_ws contains conv convert_timezone corr cos cosh cot count count_if count_min_sketch covar_pop covar_samp crc32 csc cume_dist
    curdate current_date current_time current_timestamp current_timezone date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc dateadd
    datediff datepart day dayname dayofmonth dayofweek dayofyear decimal decode degrees dense_rank div double e element_at elt encode endswith equal_null every exists exp
    explode explode_outer expm1 extract factorial filter find_in_set first first_value flatten float floor forall format_number format_string from_csv from_json from_unixtime
    from_utc_timestamp get get_json_object getbit greatest grouping grouping_id hash hex histogram_numeric hll_sketch_agg hll_sketch_estimate hll_union hll_union_agg hour
    hypot if ifnull ilike in initcap inline inline_outer instr int is_valid_utf8 is_variant_null isnan isnotnull isnull json_array_length json_object_keys json_tuple
    kll_merge_agg_bigint kll_merge_agg_double kll_merge_agg_float kll_sketch_agg_bigint kll_sketch_agg_double kll_sketch_agg_float kll_sketch_get_n_bigint
    kll_sketch_get_n_double kll_sketch_get_n_float kll_sketch_get_quantile_bigint kll_sketch_get_quantile_double kll_sketch_get_quantile_float kll_sketch_get_rank_bigint
    kll_sketch_get_rank_double kll_sketch_get_rank_float kll_sketch_merge_bigint kll_sketch_merge_double kll_sketch_merge_float kll_sketch_to_string_bigint
    kll_sketch_to_string_double kll_sketch_to_string_float kurtosis lag last last_day last_value lcase lead least left len length levenshtein like listagg ln localtimestamp
    locate log log10 log1p log2 lower lpad ltrim luhn_check make_date make_dt_interval make_interval make_time make_timestamp make_timestamp_ltz make_timestamp_ntz
    make_valid_utf8 make_ym_interval map map_concat map_contains_key map_entries map_filter map_from_arrays map_from_entries map_keys map_values map_zip_with mask max max_by
    md5 mean median min min_by minute mod mode monotonically_increasing_id month monthname months_between named_struct nanvl negative next_day not now nth_value ntile nullif
    nullifzero nvl nvl2 octet_length or overlay parse_json parse_url percent_rank percentile percentile_approx percentile_cont percentile_disc pi pmod posexplode
    posexplode_outer position positive pow power printf quarter quote radians rand randn random randstr rank reduce regexp regexp_count regexp_extract regexp_extract_all
    regexp_instr regexp_like regexp_replace regexp_substr regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy repeat replace reverse
    right rint rlike round row_number rpad rtrim schema_of_csv schema_of_json schema_of_variant schema_of_variant_agg sec second sequence session_window sha sha1 sha2
    shiftleft shiftright shiftrightunsigned shuffle sign signum sin sinh size skewness slice smallint some sort_array soundex space spark_partition_id split split_part sqrt
    st_asbinary st_geogfromwkb st_geomfromwkb st_setsrid st_srid stack startswith std stddev stddev_pop stddev_samp str_to_map string string_agg struct substr substring
    substring_index sum tan tanh theta_difference theta_intersection theta_intersection_agg theta_sketch_agg theta_sketch_estimate theta_union theta_union_agg time time_diff
    time_trunc timestamp timestamp_micros timestamp_millis timestamp_seconds tinyint to_binary to_char to_csv to_date to_json to_number to_time to_timestamp to_timestamp_ltz
    to_timestamp_ntz to_unix_timestamp to_utc_timestamp to_varchar to_variant_object transform transform_keys transform_values translate trim trunc try_add try_aes_decrypt
    try_avg try_divide try_element_at try_make_interval try_make_timestamp try_make_timestamp_ltz try_make_timestamp_ntz try_mod try_multiply try_parse_json try_parse_url
    try_subtract try_sum try_to_binary try_to_date try_to_number try_to_time try_to_timestamp try_url_decode try_validate_utf8 try_variant_get typeof ucase unbase64 unhex
    uniform unix_date unix_micros unix_millis unix_seconds unix_timestamp upper url_decode url_encode uuid validate_utf8 var_pop var_samp variance variant_get version weekday
    weekofyear when width_bucket window window_time xxhash64 year zeroifnull zip_with
    """.split()
)
