"""Heatwave chain: grid to daily table to confidence to events."""

from ..operators import detect, events


def heatwave_days_with_confidence(sst, indices):
    return detect.heatwave_confidence(detect.heatwave_days(sst, indices))


def heatwave_events(sst, indices):
    return events.heatwave_events(heatwave_days_with_confidence(sst, indices))
