"""Lag of one committed offset, given the samples around it, as SQL expressions.

They read these columns of the current row:

=========  =====================================================================
c_off      committed offset
lo_off/at  sample with the greatest offset <= c_off
up_off/at  sample with the least offset > c_off
min_off    least sampled offset of the series
max_off    greatest sampled offset of the series
bad_off    least offset whose sample time could not be parsed, usually NULL
leo/leo_at newest sample of the series
=========  =====================================================================
"""

# Offsets still to read; a commit ahead of the log end counts as zero.
LAG_OFFSETS = "if(leo is null or c_off is null, null, greatest(leo - c_off, 0L))"

# How the commit's produce time is found.  Fewer than two distinct offsets give
# nothing to place it between.  A sample without a time spoils the estimate only
# if it lies at or below the last sample needed for it.
LAG_CASE = """case
    when leo is null then null
    when min_off is null or min_off = max_off then 'insufficient'
    when bad_off <= if(lo_off = c_off, c_off, coalesce(up_off, max_off)) then 'unparsed'
    when lo_off = c_off then 'exact'
    when lo_off is null then 'below'
    when up_off is null then 'above'
    else 'interp' end"""

# Linear between two samples, truncated.  The 64-bit product is exact for
# ordinary gaps; the decimal one is evaluated only where it would overflow.
_BETWEEN = """lo_at + coalesce(
    try_multiply(c_off - lo_off, up_at - lo_at) div (up_off - lo_off),
    (cast(c_off - lo_off as decimal(19,0)) * cast(up_at - lo_at as decimal(19,0))) div cast(up_off - lo_off as decimal(19,0)))"""

# Estimated produce time of the committed offset, clamped outside the history.
ESTIMATED_MS = f"""case lag_s_case
    when 'exact' then lo_at
    when 'above' then lo_at
    when 'below' then up_at
    when 'interp' then {_BETWEEN} end"""

# Whole seconds behind the newest sample; exactly -1 means unknown, hence NULL.
LAG_SECONDS = f"nullif((leo_at - {ESTIMATED_MS}) div 1000, -1L)"
