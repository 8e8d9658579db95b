"""Sequential statement of the time lag, used to check the relational one."""


def walk_lag(history, c_off, leo_at):
    """history: (off, at_ms) in any order, at most one per offset; at_ms None is unreadable."""
    points = sorted(history)
    if len(points) < 2:
        return None
    below = above = None
    for off, at in points:
        if at is None:
            return None
        if off > c_off:
            above = (off, at)
            break
        below = (off, at)
        if off == c_off:
            break
    if below is None:
        estimate = above[1]
    elif below[0] == c_off or above is None:
        estimate = below[1]
    else:
        num = (c_off - below[0]) * (above[1] - below[1])
        den = above[0] - below[0]
        estimate = below[1] + (abs(num) // den) * (1 if num >= 0 else -1)
    gap = leo_at - estimate
    seconds = (abs(gap) // 1000) * (1 if gap >= 0 else -1)
    return None if seconds == -1 else seconds
