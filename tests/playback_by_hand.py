"""Event-at-a-time versions of the playback operators."""

import math


def fold(events, parts, state=(0, 0.0, 0.0, 0)):
    part, position, total, progress = state
    for _, _, kind, value in sorted(events, key=lambda e: e[:2]):
        if kind == "tick" and value is not None:
            position = value
            if parts:
                share = 100.0 / parts
                done = part / parts * 100.0 + min(value / 240.0 * share, share)
                progress = math.floor(done + 0.5)
        elif kind == "duration" and value and not math.isnan(value):
            total = float(math.floor(value + 0.5))
        elif kind == "ended" and parts and part < parts - 1:
            part, position = part + 1, 0.0
        elif kind == "seek" and parts and value is not None and 0 <= value < parts:
            part, position = int(value), 0.0
        elif kind == "restart":
            part, position, progress = 0, 0.0, 0
    return part, position, total, progress


def throttle(ticks, gap, last=None):
    saved = []
    for clock, tick in sorted(ticks):
        if last is None or clock - last > gap:
            saved.append(tick)
            last = clock
    return saved
